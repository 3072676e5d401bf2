"""What finds candidates, foreshadows and issues in chunks. Add an Extractor to a copy of EXTRACTORS to extend an analysis."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..packs import Pack, Profile
from . import detectors, mentions

#: What an extractor makes: rows as mentions.mentions(), detectors.foreshadows() or detectors.repeat_terms() have them.
MAKES = ("mentions", "foreshadows", "issues")


@dataclass(frozen=True)
class Extractor:
    """find(chunks, pack) gives rows of the kind that makes names; switch: the profile's switch, if it has one."""

    makes: str
    find: Callable[[DataFrame, Pack], DataFrame]
    switch: str | None = None

    def __post_init__(self):
        if self.makes not in MAKES:
            raise ValueError(f"an extractor makes one of {MAKES}, not {self.makes!r}")


EXTRACTORS = {
    "people": Extractor("mentions", mentions.person_mentions, "people"),
    "places": Extractor("mentions", mentions.place_mentions, "places"),
    "items": Extractor("mentions", mentions.item_mentions, "items"),
    "foreshadows": Extractor("foreshadows", detectors.foreshadows, "foreshadows"),
    "eye_colours": Extractor("issues", detectors.attribute_conflicts, "eye_colours"),
    "repeat_terms": Extractor("issues", detectors.repeat_terms, "repeat_terms"),
}


def chosen(profile: Profile, extractors: dict[str, Extractor] = EXTRACTORS) -> dict[str, Extractor]:
    """The extractors that the profile does not switch off."""
    return {k: x for k, x in extractors.items() if x.switch is None or getattr(profile, x.switch)}


def extracted(makes: str, extractors: dict[str, Extractor], chunks: DataFrame, pack: Pack) -> DataFrame:
    """All rows of one kind; without an extractor of the kind, none."""
    like = {"mentions": mentions.mentions, "foreshadows": detectors.foreshadows, "issues": detectors.repeat_terms}[makes]
    out = None
    for x in extractors.values():
        if x.makes == makes:
            rows = x.find(chunks, pack)
            out = rows if out is None else out.unionByName(rows)
    return like(chunks.limit(0), pack) if out is None else out
