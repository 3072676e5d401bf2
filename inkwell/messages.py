"""What issues say: titles, descriptions and suggested actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Message:
    severity: str
    title: str
    description: str
    actions: tuple[str, ...]


# The texts by which later scans and readers know an issue.
MESSAGES = {
    "character_attribute_conflict": Message("high", "%s 的眼睛颜色可能前后不一致", "%s 出现了多个眼睛颜色候选，请依据正文确认。", ("保持旧设定", "接受新设定", "标记为伪装", "标记为角色认知", "标记误报")),
    "repeat_expression": Message("low", "“%s”反复出现", "“%s”在多个正文片段中重复出现，可在修订时确认是否有意保留。", ("稍后处理", "标记为有意为之", "创建修订任务", "标记误报")),
    "rule_conflict": Message("high", "可能违反规则「%s」", "规则「%s」要求关键字「%s」一致，但正文中出现了看似矛盾的表述。", ("标记为规则例外", "接受为正式设定变更", "标记为误报")),
    "expression": Message("low", "高频重复表达", "高频表达 \"%s\" 出现在 %d 个章节。", ("检查是否为刻意重复的修辞，可考虑替换部分表达。",)),
    "action": Message("low", "重复动作：%s", "\"%s\" 出现在 %d 个不同章节", ("检查是否为刻意重复，可考虑替换同义动作。",)),
    "paragraph": Message("low", "重复场景描写", "以下段落出现在 %d 个不同章节，内容高度相似", ("检查是否为刻意重复的意象，可考虑删减或合并。",)),
    "dialogue": Message("low", "重复对白引导模式", "模式 \"%s\" 在 %d 个不同章节中出现", ("尝试使用不同的对白引导词，如'某某道'、'某某问'混合使用。",)),
    "psych_density": Message("info", "过密心理描写", "本章心理描写关键词密度 %.1f%%（%d 个关键词 / %d 字），超过阈值 %s%%。", ("考虑减少内心描写比例，适当增加对白或动作来推进叙事。",)),
    "power_regression": Message("medium", "战力倒退检查", "主角在达到高境界后又被描述为低境界，可能存在战力倒退或不一致。", ("确认是否为误写", "确认是否为隐藏实力", "标记为误报")),
    "low_streak": Message("low", "连续低爽点章节", "连续多个章节未检测到爽点词汇，可能节奏偏平。", ("检查当前章节节奏", "考虑加入冲突或反转")),
    "anachronisms": Message("medium", "时代穿帮检查", "在唐代背景下检测到现代词汇「%s」，可能为时代穿帮。", ("确认是否为故意架空", "替换为时代合适用语", "标记为误报")),
    "identity_conflicts": Message("medium", "身份地位冲突", "检测到同一角色在不同章节中出现身份地位不一致。", ("确认是否为伪装身份", "确认是否为时间线跳跃", "统一角色身份设定")),
    "diminishing_runs": Message("medium", "打脸边际递减", "检测到连续章节的打脸事件模式重复，可能导致边际递减效应。", ("调整冲突节奏", "增加事件变化", "重组章节顺序")),
    "rank_conflicts": Message("medium", "官职品级冲突", "同一人物在不同章节关联了不同品级的官职，可能前后冲突。", ("确认是否为升迁或降职", "检查是否同一人物", "补充过渡说明", "标记为误报")),
    "place_name_anachronisms": Message("medium", "地名时代检查", "唐代地名与「%s」时代表述同时出现，可能存在时代混淆。", ("确认是否为跨时代参照", "检查是否为写作用语", "标记为误报")),
    "chapter_length_anomaly": Message("low", "章节长度异常", "第%d章长度为 %.0f 字，是平均 (%.0f 字) 的 %.1f 倍，可能过长。", ("考虑拆分章节", "确认是否信息密度足够", "标记为无问题")),
}
#: Behind an expression's description, if the project has more of them.
MORE_PHRASES = "另有 %d 个高频短语。"


def said(template: str, values: tuple[Column, ...]) -> Column:
    return F.format_string(template, *values) if values else F.lit(template.replace("%%", "%"))


def issue(kind: str, *, title: tuple[Column, ...] = (), description: tuple[Column, ...] | Column = (), severity: Column | str | None = None, subject: Column | str = "") -> list[Column]:
    """Columns of an issue: type, severity, title, description, suggested_actions, and the subject that tells findings of one title apart.

    Project, type, title and subject are its key: they must not change while the finding stays, so counts belong in descriptions.
    """
    m = MESSAGES[kind]
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = description if isinstance(description, Column) else said(m.description, description)
    return [
        F.lit(kind).alias("issue_type"), lit(severity if severity is not None else m.severity).alias("severity"), said(m.title, title).alias("title"), text.alias("description"),
        F.array(*[F.lit(a) for a in m.actions]).alias("suggested_actions"), lit(subject).alias("subject"),
    ]
