"""Query clues, worked out on the driver: a query is one short string."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

# How remembered queries begin and end, and fragments that say nothing.
MEMORY_PREFIXES = "我记得 我记着 我印象中 印象中 印象里 好像 似乎 请帮我找一下 帮我找一下 帮我找找 帮我找 我想找 想找".split()
TOPIC_PREFIXES = "有一期节目 有一期 以前 之前 曾经 聊过 聊到 讲过 谈过 说过 提到过 讨论过 关于".split()
SUFFIXES = "那一期节目 那期节目 那一期 那期".split()
NOISE = frozenset("我记 我记得 记得 聊过 聊到 那期 那一期 好像 节目".split())
BRACKETS = ("《》", "“”", "【】", "（）", "()")
LONGEST_TERM, LONGEST_FRAGMENT = 24, 16
# Terms that index words never are. Names of a site are left to the caller.
STOP_TERMS = frozenset(
    "欢迎收听 欢迎收听本期节目 感谢收听 感谢收听本期节目 本期时间轴制作 请关注B站视频账号 自由的电台栏目 没有固定的更新时间 没有固定的主持人员 会员专享 广告 出品 开场BGM 结尾BGM 视频播客 特供版 本期节目 节目中 嘉宾".split()
)
STOP_PARTS = tuple("欢迎收听 感谢收听 本期时间轴 时间轴制作 请关注 完整版的视频内容 视频播客节目 固定的更新时间 固定的主持人员 会员专享 广告 节目中 嘉宾表达 大家不要 尽请老师".split())

_ANY = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_MEMORY = re.compile(rf"(?:{_ANY(MEMORY_PREFIXES)})[\s，,:：]*")
_TOPIC = re.compile(rf"(?:{_ANY(TOPIC_PREFIXES)})[\s，,:：]*")
_SUFFIX = re.compile(rf"的?(?:{_ANY(SUFFIXES)})[。！？?！\s]*$")


def squeeze(text: object) -> str:
    return " ".join(str(text or "").split())


def keep_first(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(values))


def _without_lead(pattern: re.Pattern, text: str) -> str:
    while m := pattern.match(text):
        text = text[m.end() :]
    return text


def clue(query: str) -> str:
    """The query without what only says that it is remembered; the query itself if nothing is left."""
    whole = squeeze(query)
    text = _SUFFIX.sub("", whole)
    bare = _without_lead(_MEMORY, text)
    if bare != text:
        bare = _without_lead(_TOPIC, bare)
    return squeeze(bare) or whole


def term(value: object, stop_terms: Iterable[str] = STOP_TERMS, stop_parts: Sequence[str] = STOP_PARTS, longest: int = LONGEST_TERM) -> str | None:
    """The value as an index term, or None if it is none."""
    text = squeeze(value) if isinstance(value, str) else ""
    if not 1 < len(text) <= longest or text in stop_terms or any(part in text for part in stop_parts):
        return None
    if re.fullmatch(r"[0-9]+|[\W_]+", text) or "http://" in text or "https://" in text:
        return None
    return text


def bracketed(text: str) -> list[str]:
    return [m for left, right in BRACKETS for m in re.findall(f"{re.escape(left)}([^{re.escape(right)}]{{1,{LONGEST_TERM}}}){re.escape(right)}", text)]


def hot_words(text: object) -> list[str]:
    """The whole text, bracketed parts, Latin tokens and short fragments, as far as they are terms."""
    source = text.strip() if isinstance(text, str) else ""
    bare = re.sub("[《》“”【】（）()]", " ", source)
    found = [term(source), *map(term, bracketed(source)), *map(term, re.findall(r"\b[A-Za-z][A-Za-z0-9+._:-]{1,31}\b", source))]
    found += [term(part, longest=LONGEST_FRAGMENT) for part in re.split(r"[，。！？；：、/\n\r\t|]+", bare)]
    return keep_first(t for t in found if t)


def query_terms(query: str) -> list[str]:
    """Whole clues first, then the 2- to 4-grams of clues of 4 to 12 Chinese characters."""
    text = clue(query)
    quoted = set(bracketed(text))
    parts = [text, *re.split(r"[\s,，。！？?|]+", text), *hot_words(text), *re.split("[和与及跟]", text)]
    whole = keep_first(t for t in map(squeeze, parts) if len(t) > 1 and (t not in NOISE or t == text or t in quoted))
    grams = [
        t[i : i + n]
        for t in whole
        if re.fullmatch("[一-鿿]{4,12}", t)
        for n in (2, 3, 4)
        for i in range(len(t) - n + 1)
        if t[i : i + n] not in NOISE
    ]
    return keep_first([*whole, *grams])


def recall_terms(terms: Iterable[str], most: int = 24) -> list[str]:
    """Terms that the lexical recall looks for: stripped, longer than one letter, distinct, the first ``most``."""
    return [t for t in keep_first(str(t).strip() for t in terms) if len(t) > 1][:most]


def scope_doc_types(scope: str | None, requested: Sequence[str] = ()) -> list[str]:
    """Document types that a scope searches, narrowed to the requested ones if any of them belongs to it."""
    by_scope = {"timeline": ["timeline_note"], "title": ["item_title"]}
    allowed = by_scope.get((scope or "content").strip().lower(), ["scene_summary", "episode_card"])
    wanted = [str(r).strip() for r in requested]
    return [t for t in allowed if t in wanted] or allowed
