"""Language profiles: what ends a sentence, what a token is, and the word lists. All rules and lists are this project's own choice.

``LATIN`` runs on invented European text, so its lists are words that occur there and mean nothing;
``ZH`` runs on Chinese reports, whose tokens are the longest words of its lists. Patterns keep to what Java's and RE2's regular expressions share.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Profile:
    name: str
    paragraph: str
    sentence: str
    sentence_semicolon: str
    segment: str
    token: str
    letter: str
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    negators: tuple[str, ...] = ()
    connectives: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    adversatives: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    routine: str = "$^"
    common: tuple[str, str] = ("", "")
    masks: tuple[str, ...] = ()
    tone: dict[str, tuple[str, ...]] = field(default_factory=dict)
    context: tuple[str, ...] = ()
    #: Words without a role that longest match keeps whole, so that list words inside them are no hits.
    whole: tuple[str, ...] = ()


def longest_match(p: Profile) -> Profile:
    """The profile with tokens for text without spaces: from left to right the longest word of its lists, else one Han character or a run of other letters."""
    lists = (p.positive, p.negative, p.negators, p.connectives, p.references, p.adversatives, p.terms, p.context, p.whole, *p.tone.values())
    words = sorted({w for ws in lists for w in ws}, key=lambda w: (-len(w), w))
    return replace(p, token="(?:" + "|".join(words) + r"|[\x{4e00}-\x{9fff}]|[^\P{L}\x{4e00}-\x{9fff}]+)")


LATIN = Profile(
    name="latin",
    paragraph=r"\n",
    sentence=r"[.!?\n]+",
    sentence_semicolon=r"[.!?;,\n]+",
    segment=r"[,;:.!?\n]+",
    token=r"\p{L}+",
    letter=r"[^\p{L}]",
    positive=("for", "with", "für", "mit", "pour", "avec", "para", "con"),
    negative=("idiot", "worthless", "pathetic", "stupid", "disgusting", "trash", "scum", "moron", "clown", "loser"),
    negators=("nicht", "pas", "no", "sans", "sin"),
    connectives=("and", "und", "et", "or", "mais", "aber", "pero"),
    references=("this", "that", "it"),
    adversatives=("mais", "aber", "pero", "or"),
    terms=("of", "der", "de", "the"),
    routine=r"(Released|Licensed) under the",
    common=("enairtsol", "dhucmpgbvfz"),
    masks=("Licensed under the", "Released under the"),
    tone={
        "strength": ("and", "und", "et", "y"),
        "extremity": ("is", "ist", "est", "es"),
        "certainty": ("of", "von", "en"),
        "vagueness": ("to", "zu", "pour", "para"),
        "hyperbole": ("disgusting", "pathetic"),
    },
    context=("the", "der", "la", "el"),
)

ZH = longest_match(
    Profile(
        name="zh",
        paragraph=r"<\?>",
        sentence=r"[。！？!?\n]+",
        sentence_semicolon=r"[。！？；!?;\n]+",
        segment=r"[，；：、,;:。！？!?\n]+",
        token=r"\p{L}+",
        letter=r"[^\x{4e00}-\x{9fff}]",
        positive=("增长", "改善", "良好", "提升", "看好"),
        negative=("下滑", "下降", "风险", "亏损", "恶化"),
        negators=("未", "不", "没有", "并未", "并非"),
        connectives=("因此", "但是", "同时", "此外"),
        references=("该", "其", "此", "这"),
        adversatives=("但是", "然而", "不过"),
        terms=("毛利率", "净利润", "估值"),
        routine=r"^风险(提示|因素)",
        common=("的一是了我不在有", "业绩增长收入利润"),
        masks=("强烈推荐", "谨慎推荐"),
        tone={"strength": ("强烈", "大幅"), "extremity": ("极其", "绝对"), "certainty": ("必然", "确定"), "vagueness": ("可能", "或许"), "hyperbole": ("史无前例",)},
        context=("评级",),
        whole=("未来", "不断", "不仅", "不但", "不同", "不少", "不管", "不论", "不良", "不动产", "不锈钢", "不确定", "不确定性", "负增长"),
    )
)

#: Decisions on the tone list that lead to its second version: word, action, new dimension.
DECISIONS = (("y", "remove", None), ("est", "redim", "certainty"), ("et", "rerole", "strength"))
#: Words that reviewers admitted to the second version.
ADMITTED = (("moron", "hyperbole"), ("trash", "hyperbole"), ("clown", "hyperbole"))


def tone_words(profile: Profile, version: int = 1) -> list[tuple[str, str]]:
    """(word, dimension) of a version of the tone list."""
    rows = [(w, d) for d, ws in profile.tone.items() for w in ws]
    if version == 1:
        return rows
    decided = {w: (a, d) for w, a, d in DECISIONS}
    out = []
    for w, d in rows:
        action, new = decided.get(w, ("keep", None))
        if action != "remove":
            out.append((w, new if action == "redim" else d))
    return out + [x for x in ADMITTED if x not in out]
