"""Language packs: patterns, lexicons and thresholds of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Pack:
    heading: str
    delimiters: str
    person_patterns: tuple[str, ...]
    place_pattern: str
    item_patterns: tuple[str, ...]
    item_prefixes: tuple[str, ...]
    stopwords: tuple[str, ...]
    bad_prefixes: tuple[str, ...]
    bad_suffixes: tuple[str, ...]
    bad_infixes: tuple[str, ...]
    name_length: tuple[int, int]
    alias_suffixes: tuple[str, ...]
    markers: tuple[str, ...]
    related: str
    attribute: str
    watched: tuple[str, ...]
    verbs: tuple[str, ...]
    guides: tuple[str, ...]
    psych: tuple[str, ...]
    quotes: tuple[str, str]
    prohibition: str
    prerequisite: str
    contradictions: tuple[str, ...]
    relative: str
    absolute: str
    flashback: str
    power_high: tuple[str, ...]
    power_low: tuple[str, ...]
    streak: tuple[str, ...]
    modern: tuple[str, ...]
    tiers: dict[str, tuple[str, ...]]
    protagonist: str
    events: tuple[str, ...]
    setups: tuple[str, ...]
    reactions: tuple[str, ...]
    ranks: dict[str, tuple[str, ...]]
    other_periods: dict[str, tuple[str, ...]]
    near_run: str
    pleasure: tuple[str, ...] = ()
    conflict: tuple[str, ...] = ()
    upgrade: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)
    #: Modern words that are checked for besides, but not counted in the metric.
    modern_more: tuple[str, ...] = ()
    #: What stands between a speaker's verb and the words said.
    speech: str = "[：:]"


# Word lists, patterns and limits that results depend on.
ZH = Pack(
    heading=r"(?i)^(?:第[\p{IsHan}0-9０-９〇零一二三四五六七八九十百千万两]+[章节回卷部].*|卷[\p{IsHan}0-9０-９〇零一二三四五六七八九十百千万两]+.*|序章|楔子|番外.*|chapter\s+[0-9]+.*|[0-9０-９]{3,}\s*[-_－—].*)$",
    delimiters="[。！？\n]",
    person_patterns=(
        r"(\p{IsHan}{2,4})(?:说|问|道|喊|低声|笑道|看着|走进|转身)",
        r"(?:向|对|跟)(\p{IsHan}{2,4})(?:说|问|道)",
        r"(\p{IsHan}{1,2}(?:兄|姐|弟|妹|叔|伯|婶|嫂|娘|爷|公|子|生|师|徒|君))",
        r"\"(\p{IsHan}{2,4})[，,]",
    ),
    place_pattern=r"(\p{IsHan}{1,6}(?:城|镇|村|街|巷|楼|塔|宫|殿|府|山|谷|阁|院|桥|寺|观|港|站|基地|星球|舰船))",
    item_patterns=(r"(钥匙|信|戒指|刀|剑|书|照片|芯片|卷轴|玉佩|伞|令牌|地图|药瓶|手札|玉简)", r"(?:拿起|藏起|交给|寻找|丢失|夺走|握住)(\p{IsHan}{1,6})"),
    item_prefixes=("那枚", "这枚", "一枚", "那把", "这把", "一把", "那封", "这封", "一封"),
    stopwords=("自己", "什么", "这里", "那里", "哪里", "这个", "那个", "他们", "我们", "你们", "没有", "不是", "已经", "突然", "之后", "以前", "此时", "这时", "那时", "一边"),
    bad_prefixes=("的", "了", "在", "一", "不", "这", "那", "什", "怎"),
    bad_suffixes=("吗", "么", "的", "了", "着", "过", "里", "中", "上", "下", "前", "后"),
    bad_infixes=("的", "了", "在", "一个", "这个", "那个", "什么"),
    name_length=(2, 4),
    alias_suffixes=("兄", "公子"),
    markers=("秘密", "线索", "预感", "总觉得", "似乎", "好像", "日后", "终有一日", "钥匙", "信物", "谜"),
    related=r"(\p{IsHan}{2,4})",
    attribute=r"(?d)(\p{IsHan}{2,4}).{0,12}(黑色|灰蓝色|蓝色|褐色|金色|红色|琥珀色).{0,8}(?:眼睛|眼眸|眸子)",
    watched=("雨夜", "沉默", "钟声", "秘密", "黑暗"),
    verbs=("拿起", "推开", "放下", "抱住", "握住", "拉着", "拍了拍", "点了点头", "摇了摇头", "站起身", "转过身", "低下头", "抬起头", "握紧", "松开", "扔下", "接过", "取出", "收起", "拔出", "插入"),
    guides=("说", "问", "道", "答道", "问道", "开口", "压低声音", "笑道", "叹道", "说道", "解释道", "补充道", "喊道", "叫道", "继续道"),
    psych=("想", "觉得", "感到", "知道", "明白", "以为", "仿佛", "似乎", "也许", "大概", "应该", "可能", "突然", "忽然", "不知", "记得", "忘记", "怕", "担心", "希望", "期待", "疑惑", "怀疑", "猜测", "推测", "意识到", "体会到", "感觉到", "领悟到"),
    quotes=("「", "」"),
    prohibition=r"(\p{IsHan}{2,20})(?:不能|无法|不可|禁止|不得|不允许|从不|从未)(\p{IsHan}{2,40})",
    prerequisite=r"只有(\p{IsHan}{2,20})(?:才|才能)(\p{IsHan}{2,40})",
    contradictions=("却", "但是", "然而", "居然", "竟然", "还是", "照常", "依然"),
    relative=r"(\d+|[一二三四五六七八九十百千万]+)(?:天|个?月|年)(?:[后之]?[后前])",
    absolute=r"(天宝|贞观|开元|神龙|武德|乾元|大历|建中|贞元|元和|长庆|宝历|太和|开成|会昌|大中|咸通|乾符|广明|中和|光启|文德|龙纪|大顺|景福|乾宁|光化|天复|天祐|景德|祥符|天禧|乾兴|天圣|明道|景祐|宝元|康定|庆历|皇祐|至和|嘉祐|治平|熙宁|元丰|元祐|绍圣|元符|靖国|崇宁|大观|政和|重和|宣和|靖康|建炎|绍兴|隆兴|乾道|淳熙|绍熙|庆元|嘉泰|开禧|嘉定|宝庆|绍定|端平|嘉熙|淳祐|宝祐|开庆|景定|咸淳|德祐|景炎|祥兴)(\d+|[一二三四五六七八九十百千万]+)(?:载|年)?",
    flashback=r"(回忆起|想起|回想|那年|曾经|当时|那时|多年前|很久以前)",
    power_high=("金丹", "元婴", "化神", "大乘", "渡劫", "大圆满", "巅峰"),
    power_low=("炼气", "筑基", "开光", "融合", "后天", "先天"),
    streak=("打脸", "震惊", "碾压", "逆袭", "翻盘", "爆"),
    modern=("手机", "电脑", "电视", "网络", "微信", "互联网", "数据", "芯片", "程序", "代码", "AI", "算法"),
    modern_more=("蓝牙", "WiFi"),
    tiers={
        "high": ("皇帝", "太子", "王爷", "公主", "宗主", "上仙", "掌门", "帝王", "至尊", "大帝"),
        "medium": ("少爷", "小姐", "公子", "将军", "长老", "县令", "知府", "家主", "丞相", "尚书"),
        "low": ("平民", "奴仆", "丫鬟", "乞丐", "散修", "杂役", "下人", "婢女", "小厮", "村童"),
    },
    protagonist="主角",
    events=("打脸", "震惊", "碾压", "逆袭", "翻盘", "爆", "目瞪口呆", "骇然", "震撼", "跪", "全场"),
    setups=("挑衅", "羞辱", "侮辱", "嘲讽"),
    reactions=("众人", "全场", "目瞪口呆", "跪"),
    ranks={
        "high": ("丞相", "尚书", "中书令", "太尉", "司徒", "司空", "御史大夫", "大将军"),
        "mid": ("侍郎", "郎中", "员外郎", "刺史", "太守", "都督", "将军", "校尉"),
        "low": ("县令", "县尉", "主簿", "参军", "录事", "典史", "巡检", "驿丞"),
    },
    other_periods={"汉": ("西汉", "东汉", "汉武帝", "汉朝"), "宋": ("北宋", "南宋", "宋朝", "赵匡胤"), "明": ("明朝", "朱元璋", "永乐"), "清": ("清朝", "乾隆", "康熙")},
    near_run=r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]{2,})",
    pleasure=("打脸", "震惊", "碾压", "逆袭", "翻盘", "爆", "众人", "全场", "目瞪口呆", "骇然", "震撼", "跪"),
    conflict=("挑衅", "羞辱", "赌约", "竞争", "对抗", "冲突", "战斗", "厮杀", "压迫", "侮辱"),
    upgrade=("晋级", "突破", "进阶", "提升", "升级"),
    weights={"打脸": 1.0, "震惊": 2.0, "目瞪口呆": 2.0, "骇然": 2.0, "震撼": 2.0, "碾压": 3.0, "跪": 2.0, "全场": 1.0},
)

#: For prose in Latin letters, with English lexicons: capitalised names, chapters by number or a line of one or two words.
LATIN = replace(
    ZH,
    heading=r"(?i)^(?:chapter\s+[0-9ivxlc]+.*|prologue|epilogue|\w+(\s\w+)?\.)$",
    delimiters="[.!?\n]",
    person_patterns=(r"([A-ZÀ-Þ][a-zà-ÿ]+) (?:said|asked|replied|whispered|shouted|looked|walked|turned) ", r" (?:told|asked|to) ([A-ZÀ-Þ][a-zà-ÿ]+)"),
    place_pattern=r" (?:in|at|near|from|toward) ([A-ZÀ-Þ][a-zà-ÿ]+)",
    item_patterns=(r"(key|letter|ring|knife|sword|book|photograph|scroll|umbrella|map|bottle)", r" (?:picked up|hid|lost|stole|held) (?:the|a|an) ([a-zà-ÿ]{3,12})"),
    item_prefixes=("the ", "a ", "an "),
    stopwords=("The", "And", "But", "This", "That", "There", "When", "Then"),
    bad_prefixes=("Th",),
    bad_suffixes=("ly",),
    bad_infixes=("tion",),
    name_length=(2, 20),
    alias_suffixes=(".", " Sr", " Jr"),
    markers=("secret", "clue", "omen", "somehow", "as if", "one day", "riddle", "key"),
    related=r"([A-ZÀ-Þ][a-zà-ÿ]+)",
    attribute=r"([A-ZÀ-Þ][a-zà-ÿ]+)[^\n]{0,12} (black|blue|grey|brown|golden|red|green|amber) [^\n]{0,8}eyes",
    watched=("night", "silence", "bell", "secret", "darkness"),
    verbs=("picked up", "pushed open", "put down", "embraced", "nodded", "shook", "stood up", "turned around", "looked up", "let go", "drew"),
    guides=("said", "asked", "replied", "whispered", "shouted", "added", "explained", "laughed", "sighed"),
    psych=("thought", "felt", "knew", "believed", "wondered", "perhaps", "suddenly", "remembered", "forgot", "feared", "worried", "hoped", "doubted", "guessed", "realised"),
    quotes=("“", "”"),
    speech="[,:]",
    prohibition=r"([a-z]{2,20}) (?:cannot|must not|may not|never) ([a-z]{2,40})",
    prerequisite=r"only ([a-z]{2,20}) can ([a-z]{2,40})",
    contradictions=("but", "however", "yet", "still", "nevertheless", "as usual"),
    relative=r"([0-9]{1,6}) (?:days?|months?|years?) (?:later|earlier)",
    absolute=r"(year|anno) ([0-9]{1,4})",
    flashback=r"(remembered|recalled|that year|once|back then|years ago|long ago)",
    power_high=("grandmaster", "archmage", "immortal"),
    power_low=("apprentice", "novice", "beginner"),
    streak=("triumph", "stunned", "crushed", "victory"),
    modern=("phone", "computer", "television", "internet", "data", "program", "algorithm"),
    modern_more=("wifi",),
    tiers={"high": ("king", "queen", "emperor", "prince"), "medium": ("general", "baron", "mayor", "captain"), "low": ("servant", "beggar", "maid", "peasant")},
    protagonist="the hero",
    events=("triumph", "stunned", "crushed", "victory", "kneel", "speechless"),
    setups=("provoke", "insult", "mock", "humiliate"),
    reactions=("everyone", "the crowd", "speechless", "kneel"),
    ranks={"high": ("chancellor", "minister", "marshal"), "mid": ("governor", "general", "prefect"), "low": ("clerk", "constable", "scribe")},
    other_periods={"roman": ("Caesar", "legion"), "medieval": ("crusade", "serf")},
    near_run=r"([A-Za-zÀ-ÿ]{2,})",
    pleasure=("triumph", "stunned", "crushed", "victory", "everyone", "kneel", "speechless"),
    conflict=("provoke", "insult", "wager", "duel", "battle", "fight", "clash"),
    upgrade=("promoted", "breakthrough", "advanced", "improved"),
    weights={"triumph": 1.0, "stunned": 2.0, "speechless": 2.0, "crushed": 3.0, "kneel": 2.0},
)
PACKS = {"zh": ZH, "latin": LATIN}


@dataclass(frozen=True)
class Profile:
    """What a kind of book is analysed for."""

    name: str = "base"
    people: bool = True
    places: bool = True
    items: bool = True
    foreshadows: bool = True
    eye_colours: bool = True
    repeat_terms: bool = True
    checks: tuple[str, ...] = ()

    @property
    def kinds(self) -> tuple[str, ...]:
        return tuple(k for k in ("people", "places", "items") if getattr(self, k))


def merged(profiles: tuple[Profile, ...]) -> Profile:
    """The profile that does what any of these does; checks in the order in which they are first named."""
    on = {k: any(getattr(p, k) for p in profiles) for k in ("people", "places", "items", "foreshadows", "eye_colours", "repeat_terms")}
    return Profile("+".join(p.name for p in profiles), **on, checks=tuple(dict.fromkeys(c for p in profiles for c in p.checks)))
