"""Text functions as column expressions: tokens, sentences, previews, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lang import CHINESE_STOP_CHARS, CJK, STOPWORDS, detect_language, listed_in

TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\-]*"


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def close_cjk_gaps(text: Column) -> Column:
    """White space between two Chinese or Japanese characters goes."""
    return F.regexp_replace(text, f"(?<=[{CJK}])\\s+(?=[{CJK}])", "")


def raw_tokens(text: Column) -> Column:
    """Lower-case words, numbers and codes; Chinese runs as overlapping pairs."""
    pieces = F.regexp_extract_all(close_cjk_gaps(F.lower(text)), F.lit(TOKEN), F.lit(0))
    # most texts have no such runs, and their pieces are the tokens
    plain = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    runs = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), pairs(r)).otherwise(F.array(r))))
    return F.when(text.rlike(f"[{CJK}]"), cut).otherwise(plain)


def tokens(text: Column, language: Column | None = None) -> Column:
    """Tokens without the stop words of the text's language and without single letters."""
    code = detect_language(text) if language is None else language
    raw = raw_tokens(text)

    def kept(words: list[str]) -> Column:
        keep = lambda t: F.when((t >= CJK[0]) & t.rlike(f"^[{CJK}]"), ~t.rlike(f"^[{CHINESE_STOP_CHARS}]+$")).otherwise((F.length(t) > 1) & (~listed_in(t, words) if words else F.lit(True)))
        return F.filter(raw, keep)

    def by_language(code: Column) -> Column:
        return F.when(code == "de", kept(STOPWORDS["de"])).when(code == "ar", kept(STOPWORDS["ar"])).when(code == "ur", kept(STOPWORDS["ur"])).when(code == "zh", kept([])).otherwise(kept(STOPWORDS["en"]))

    # bound once, so that the language isn't found out again for every token
    return F.transform(F.array(code), by_language)[0]


def content_tokens(text: Column, language: Column | None = None) -> Column:
    return F.array_distinct(tokens(text, language))


def split_sentences(text: Column) -> Column:
    """Sentences by stop and capital, and after the full stops of other scripts."""
    blocks = F.transform(F.split(text, r"\n{2,}"), normalize_ws)
    latin = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?]) (?=[A-Z0-9\"'(\[])")))
    every = F.flatten(F.transform(latin, lambda s: F.split(s, "(?<=[。！？؟۔])")))
    return F.filter(F.transform(every, lambda s: F.trim(s)), lambda s: s != "")


def preview(text: Column, limit: int = 240) -> Column:
    """One line of at most `limit` characters, cut at a space if that isn't too early."""
    line = normalize_ws(text)
    head = F.substring(line, 1, limit)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (last > 0.6 * limit), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(cut, r"[,.;:\s]+$", ""), F.lit(" [...]")))


def text_hash(text: Column) -> Column:
    return F.md5(F.lower(normalize_ws(text)))


# The marker, and what text addressed to an assistant looks like.
REMOVED = "[removed: text addressed to the assistant rather than the reader]"
ROLE_TAG = r"(?iU)<\s*(system|assistant|instructions?)\s*>[^<]{0,500}(?:<\s*/\s*\1\s*>)?|<\s*/\s*(?:system|assistant|instructions?)\s*>"
_SPACE = r"[^.!?\n]{0,40}"
INJECTION = "|".join([
    rf"\b(?:ignore|disregard|forget|override){_SPACE}\b(?:previous|prior|above|earlier|all|any|your)\b{_SPACE}\b(?:instructions?|prompts?|rules|directions|guidelines)\b",
    r"\b(?:reveal|print|repeat|show)\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions)\b",
    r"\b(?:system|developer)\s+prompt\b",
    r"\bnew\s+instructions?\s*:",
    r"\bdo\s+not\s+(?:tell|inform)\s+the\s+user\b",
    rf"\b(?:ignoriere|ignorieren|vergiss|vergessen){_SPACE}\b(?:anweisungen|instruktionen|regeln)\b",
])


def strip_injections(text: Column) -> Column:
    """struct(text, removed): role-tag spans, then sentences addressed to an assistant, give way to one marker.

    Text that matches nothing comes back as it is; sentences of other text are joined with single spaces.
    """
    spans = F.regexp_count(text, F.lit(ROLE_TAG))
    text = F.regexp_replace(text, ROLE_TAG, REMOVED)
    sentences = F.split(text, r"(?<=[.!?])\s+")
    hit = lambda s: s.rlike(f"(?i)(?:{INJECTION})")
    removed = F.size(F.filter(sentences, hit))
    marked = F.transform(sentences, lambda s: F.when(hit(s), F.lit(REMOVED)).otherwise(s))
    before = lambda i: F.element_at(marked, i)
    kept = F.filter(marked, lambda s, i: (i == 0) | (s != REMOVED) | (before(F.greatest(i, F.lit(1))) != REMOVED))
    return F.struct(F.when(removed > 0, F.array_join(kept, " ")).otherwise(text).alias("text"), (spans + removed).alias("removed"))


def format_number(x: Column) -> Column:
    """Whole numbers with separators, others to four places without trailing zeros."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.format_number(x, 0)).otherwise(F.regexp_replace(F.regexp_replace(F.format_number(x, 4), "0+$", ""), r"\.$", ""))
