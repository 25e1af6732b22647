"""Column functions on text: tokenizers, lines, locators, paths, snippets, headings, identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the inverted index leaves out.
STOP_WORDS = (
    "的 了 是 在 和 就 不 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 什么 他 她 "
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "to of in for on with at by from as into through during before after above below between and but or nor so yet "
    "it its this that these those"
).split()
#: Three more that only the library tokenizer leaves out.
LIBRARY_STOP_WORDS = [*STOP_WORDS, "我", "有", "人"]

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column, style="index") -> Column:
    """Tokens in order: ``index`` and ``library`` drop single ASCII letters or digits and stop words, ``cloud`` drops nothing.

    Words are runs of letters and digits; ``cjk`` is ``index`` with runs of ideographs cut into pairs.  A style may also
    be an object with a method ``tokens``, such as a ``segmentation.Segmenter``.
    """
    if not isinstance(style, str):
        return style.tokens(text)
    low = F.lower(F.coalesce(text, F.lit("")))
    if style == "cloud":
        return F.filter(F.split(low, r"\s+"), lambda t: t != "")
    if style == "cjk":
        pairs = F.regexp_replace(low, r"(\p{IsHan})(?=\p{IsHan})", "$1\u0001")
        words = F.regexp_extract_all(pairs, F.lit(r"([\p{L}\p{N}_\x01]+)"), F.lit(0))
        ideographs = lambda w: F.split(w, "\u0001")
        cut = lambda w: F.when(F.contains(w, F.lit("\u0001")), F.transform(F.sequence(F.lit(1), F.size(ideographs(w)) - 1), lambda i: F.concat(F.get(ideographs(w), i - 1), F.get(ideographs(w), i)))).otherwise(F.array(w))
        words = F.flatten(F.transform(words, cut))
    else:
        words = F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(0))
    stop = LIBRARY_STOP_WORDS if style == "library" else STOP_WORDS
    # A set lookup; the pattern is only tried on single characters.
    return F.filter(words, lambda t: ((F.length(t) > 1) | ~t.rlike("^[a-z0-9]$")) & ~t.isin(*stop))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, from 1, clamped; an end before the start counts as the start."""
    n = F.size(lines(text))
    a = F.least(F.greatest(first, F.lit(1)), n)
    b = F.least(F.greatest(last, a), n)
    return F.array_join(F.slice(lines(text), a, b - a + 1), "\n")


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, from 1; what lies beyond the text's end is left out."""
    return F.array_join(F.slice(lines(text), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def locator_range(locator: Column) -> Column:
    """struct(first, last) of ``line:a``, ``lines:a-b``; null where the locator is of another kind."""
    p = r"^lines?:(\d+)(?:-(\d+))?$"
    a = F.regexp_extract(locator, p, 1)
    b = F.regexp_extract(locator, p, 2)
    return F.when(locator.rlike(p), F.struct(a.try_cast("int").alias("first"), F.coalesce(F.nullif(b, F.lit("")), a).try_cast("int").alias("last")))


def strip_page_markers(text: Column) -> Column:
    """Without ``<!-- page: n -->`` lines, at most one blank line in a row, trimmed."""
    x = F.regexp_replace(text, r"(?m)^[ \t]*<!--\s*page:?\s*\d+\s*-->[ \t]*$", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def display_locator(locator: Column, path: Column) -> Column:
    """How a place is shown: sheets as they are, PDF pages, DOCX headings, paragraphs and tables, else lines."""
    ext = extension(path)
    num = lambda p: F.regexp_extract(locator, p, 1)
    return (
        F.when(ext.isin("xls", "xlsx"), locator)
        .when((ext == "pdf") & locator.rlike(r"^page:\d+"), F.concat(F.lit("page "), num(r"^page:(\d+)")))
        .when(ext.isin("doc", "docx") & locator.rlike(r"^heading:"), F.concat(F.lit("heading "), num(r"^heading:(.*)$")))
        .when(ext.isin("doc", "docx") & locator.rlike(r"^para:\d+$"), F.concat(F.lit("paragraph "), num(r"^para:(\d+)$")))
        .when(ext.isin("doc", "docx") & locator.rlike(r"^table:\d+$"), F.concat(F.lit("table "), num(r"^table:(\d+)$")))
        .when(locator.rlike(r"^lines?:\d+-\d+$"), F.concat(F.lit("lines "), num(r"^lines?:(\d+-\d+)$")))
        .when(locator.rlike(r"^line:\d+$"), F.concat(F.lit("line "), num(r"^line:(\d+)$")))
        .otherwise(locator)
    )


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+$", "")


def relative_path(path: Column, base: Column) -> Column:
    """The path below base; null where it isn't below."""
    return F.when(path == base, F.lit("")).when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.lit(1 << 30)))


def parent_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path == ".", F.lit(None)).otherwise(F.lit(".")))


def depth(path: Column) -> Column:
    return F.when(path == ".", 0).otherwise(F.size(F.split(path, "/")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def sentences(text: Column) -> Column:
    """Sentences end at 。！？.!? but not at a point before a digit; trimmed, blanks dropped."""
    cut = F.split(F.regexp_replace(text, r"([。！？!?]|\.(?!\d))", "$1\u0001"), "\u0001")
    trimmed = F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}[ \t]+.+)$"), F.lit(1))


def heading_text(text: Column) -> Column:
    """First two non-blank lines, and of the next two those that look like headings."""
    found = F.filter(lines(text), lambda x: F.trim(x) != "")
    return F.array_join(F.filter(F.slice(found, 1, 4), lambda x, i: (i < 2) | structured(x)), "\n")


def structured(line: Column) -> Column:
    """Markdown headings and numbered headings of Chinese documents."""
    return line.rlike(r"(?m)^\s*#{1,6}\s|第[一二三四五六七八九十百千0-9]+[章节条款]|^\s*[一二三四五六七八九十]+、")


def snippet(text: Column, needle: Column, around: int = 24, head: int = 48) -> Column:
    """The first match with ``around`` characters on either side, or the first ``head`` characters; both sides are trimmed.

    A needle that does not stand in the text is looked for by its parts of two characters or more, in their order; the
    place then has the whole needle's length.  A blank needle or text gives the empty text.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    text, needle = strip(text), strip(F.lit(needle) if isinstance(needle, str) else needle)
    parts = F.filter(F.transform(F.split(needle, r"[\s,，。；;、/]+"), F.trim), lambda p: F.length(p) >= 2)
    found = F.filter(F.transform(F.concat(F.array(needle), parts), lambda p: F.instr(text, p)), lambda n: n > 0)
    at = F.coalesce(F.get(found, F.lit(0)), F.lit(0))
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + F.length(needle) - 1 + around, F.length(text))
    hit = F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), F.substring(text, first, last - first + 1), F.when(last < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when((F.length(text) == 0) | (F.length(needle) == 0), "").when(at > 0, hit).otherwise(F.substring(text, 1, head))


def search_text(text: Column) -> Column:
    """Cell text for search: without table bars and Markdown marks, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[|#*_`]", " "), r"\s+", " "))


def boilerplate_line(line: Column) -> Column:
    x = F.regexp_replace(F.lower(line), r"https?://\S+", "<url>")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\d+", "#"), r"\s+", " "))


def private_host(url: Column) -> Column:
    """True for URLs that must not be fetched: other schemes than http(s), local and private hosts."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    return ~scheme.isin("http", "https") | (host == "") | host.rlike(r"^(localhost|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[?::1\]?|\[?f[cd].*\]|.*\.local|.*\.internal)$")


def file_id(project: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", project, path).cast("binary"), 256), 1, 16)


def chunk_id(file: Column, index: Column, padded: bool = True) -> Column:
    """``file:0007`` locally, ``file:7`` in the cloud profile; numbers over 9999 keep all digits."""
    text = index.cast("string")
    return F.concat_ws(":", file, F.when(index < 10000, F.lpad(text, 4, "0")).otherwise(text) if padded else text)


def change_hash(content: Column, size: Column, modified_ms: Column, limit: int = 200 << 20) -> Column:
    return F.when(size <= limit, F.md5(content)).otherwise(F.concat_ws(":", size.cast("string"), modified_ms.cast("string")))


def glob_regex(pattern: str) -> str:
    """A path pattern as an anchored regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    pattern = pattern.strip().replace("\\", "/").strip("/") or "**/*"
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: parts.get(m[0]) or re.escape(m[0]), pattern) + "$"


def positive_int(value: Column, text: bool = True) -> Column:
    """A whole number above 0, or null; of a text the digits that it begins with."""
    n = F.regexp_extract(value, r"^\s*\+?(\d+)", 1).try_cast("bigint") if text else F.when(value == F.floor(value), value).try_cast("bigint")
    return F.when(n > 0, n)


def tokens_by_length(text: Column) -> Column:
    """An estimate: a quarter of the characters."""
    return F.ceil(F.length(text) / 4)


def tokens_by_sample(total: Column, sample: Column, tokens: Column) -> Column:
    """An estimate from a sample of so many characters with so many tokens."""
    return F.when(sample > 0, F.ceil(total / sample * tokens)).otherwise(0)


def archive(*parts: tuple[str, Column]) -> Column:
    """A map of an archive's names to their texts."""
    return F.map_from_entries(F.array(*[F.struct(F.lit(name), value.cast("string")) for name, value in parts]))


def query_terms(query: str) -> list[str]:
    """Terms of a query: without brackets and question marks, split at punctuation and spaces, two characters at least."""
    text = re.sub(r"[（(][^）)]*[）)]", " ", query)
    found = [t for t in re.split(r"[\s,，。;；:：、!！?？\"'“”‘’/|]+", text) if len(t) >= 2]
    return list(dict.fromkeys(found))


def query_terms_of(query: Column) -> Column:
    """``query_terms`` as a column."""
    text = F.regexp_replace(query, r"[（(][^）)]*[）)]", " ")
    return F.array_distinct(F.filter(F.split(text, "[\\s,，。;；:：、!！?？\"'“”‘’/|]+"), lambda t: F.length(t) >= 2))
