"""Text measures, identities and normal forms as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the approximate token count weighs, in tokens, and characters per token.
PROSE, CODE, PATH = 3.5, 2.5, 3.5
MARK, CJK, EMOJI, MARGIN = 0.8, 1.2, 2.5, 1.1
CODE_BLOCK = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`]+`"
PATHS = r"(?:/[\w.-]+)+"
MARKS = """!?,.:;'"()[]{}@#$%^&*+=|\\<>~-/"""
PUNCTUATION = r"""[!?,.:;'"()\[\]{}@#$%^&*+=|\\<>~\-/]"""
CJK_CHARS = r"[一-鿿぀-ゟ゠-ヿ가-힯㐀-䶿]"
EMOJI_CHARS = r"[\x{1F300}-\x{1F9FF}☀-⛿✀-➿⌀-⏿←-⇿■-◿⬀-⯿]"
VARIATION = r"[︎️]"


def once(c: Column) -> Column:
    """The same value, worked out where it stands: the row number in it keeps filters from being pushed below.

    Pushed into higher-order functions, an expression would be worked out anew for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def bound(c: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_characters(c: Column, characters: str) -> Column:
    without = F.replace(c, F.lit(characters), F.lit("")) if len(characters) == 1 else F.translate(c, characters, "")
    return F.length(c) - F.length(without)


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def total(items: Column, each) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + each(x))


def token_count(text: Column) -> Column:
    """Approximate tokens: weighted lengths of code, paths, marks, newlines, wide characters and prose, plus a tenth.

    Null counts as empty: 0. What a text can't hold isn't looked for: code without a backquote, paths without a slash, wide
    characters where every character is a byte.
    """
    none = F.array().cast("array<string>")

    def code(block: Column) -> Column:
        over = F.when(block.rlike(r"^```\w"), 6.0).otherwise(4.0)
        body = F.regexp_replace(F.regexp_replace(block, r"^```\w*\n?", ""), r"\n?```$", "")
        return F.greatest(over, over + count_characters(body, "\n") + F.length(body) / CODE)

    def slashes(p: Column) -> Column:
        return count_characters(p, "/")

    def weighed(t: Column, prose: Column, outside: Column, rest: Column) -> Column:
        wide = lambda pattern: F.when(F.octet_length(t) == F.length(t), 0).otherwise(count(t, pattern))
        quoted = lambda x, pattern: F.when(F.contains(x, F.lit("`")), found(x, pattern)).otherwise(none)
        paths = F.when(F.contains(outside, F.lit("/")), found(outside, PATHS)).otherwise(none)
        counts = F.struct(count_characters(rest, MARKS).alias("marks"), count_characters(rest, "\n").alias("lines"), wide(CJK_CHARS).alias("cjk"), wide(EMOJI_CHARS).alias("emoji"), wide(VARIATION).alias("variation"))

        def estimate(n: Column) -> Column:
            plain = F.greatest(F.lit(0), F.length(rest) - n["lines"] - n["cjk"] - n["emoji"] - n["variation"] - n["marks"])
            inner = total(quoted(t, CODE_BLOCK), code) + total(quoted(prose, INLINE_CODE), lambda x: 2 + (F.length(x) - 2) / CODE)
            out = plain / PROSE + n["lines"] + inner + total(paths, lambda p: slashes(p) + (F.length(p) - slashes(p)) / PATH)
            return out + n["marks"] * MARK + n["cjk"] * CJK + n["emoji"] * EMOJI + n["variation"]

        return F.ceil(bound(counts, estimate) * MARGIN).cast("int")

    without = lambda x, sign, pattern: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, "")).otherwise(x)
    return bound(F.coalesce(text, F.lit("")), lambda t: bound(without(t, "`", CODE_BLOCK), lambda prose: bound(without(prose, "`", INLINE_CODE), lambda outside: bound(without(outside, "/", PATHS), lambda rest: weighed(t, prose, outside, rest)))))


def trimmed(text: Column) -> Column:
    """A text without white space at its ends; one that has none there isn't searched."""
    edge = lambda t, i: F.substring(t, i, 1).isin(*" \t\n\x0b\f\r\x85\u2028\u2029")
    return bound(text, lambda t: F.when(edge(t, 1) | edge(t, -1), F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(t))


def word_count(text: Column) -> Column:
    """Words parted by white space; null and blank: 0."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def doc_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def slug(text: Column) -> Column:
    """Lower case, without all but ASCII word characters, white space and hyphens; runs of those are one hyphen."""
    kept = F.regexp_replace(F.lower(text), r"[^\w\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), r"-+", "-"))


#: The longest slug that is part of a section's id.
LONGEST_SLUG = 64


def section_id(path: Column, heading: Column, start_line: Column) -> Column:
    """Document, slug and line. Document and line alone tell sections apart, and every posting has the id: so of a slug of
    over LONGEST_SLUG characters, as the first line of a text without headings gives, the hash stands for it."""
    short = bound(slug(heading), lambda name: F.when(F.length(name) > LONGEST_SLUG, F.substring(F.md5(name), 1, 12)).otherwise(name))
    return F.concat(doc_id(path), F.lit("-"), short, F.lit("-L"), start_line.cast("string"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def normalized(text: Column) -> Column:
    """What counts when sections are compared: trimmed, LF, runs of blanks as one, at most one empty line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    t = F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def preprocess_query(query: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\w\s]", " "), r"\s+", " "))


#: The boosts of a heading term and of an important file, and the names of such files.
HEADING_BOOST, FILE_BOOST = 0.05, 0.03
IMPORTANT = r"(?i)(?:^|/)(?:(?:readme|index|changelog)\.md$|getting-?started|introduction|overview|quickstart)"


def heading_boost(heading: Column, query: Column) -> Column:
    """For each term of the query that the heading contains, a repeated term counting again."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(heading), t))) * HEADING_BOOST


def file_boost(path: Column) -> Column:
    return F.when(path.rlike(IMPORTANT), FILE_BOOST).otherwise(0.0)


#: Queries that an expansion helps.
QUESTION = r"^(?:how|what|why|when|where|who|which|can|could|should|would|is|are|does|do)\s|\?$"
PROCEDURE = r"\b(?:setup|install|configure|implement|create|build|fix|debug|resolve|step|guide|tutorial|example|documentation)\b"


def should_expand(query: Column) -> Column:
    """Three words or more, not a quoted phrase, and a question, a procedure or six words."""
    q = F.lower(F.trim(query))
    words = F.size(F.split(q, r"\s+"))
    quoted = F.startswith(query, F.lit('"')) & F.endswith(query, F.lit('"'))
    return (words >= 3) & ~quoted & (q.rlike(QUESTION) | q.rlike(PROCEDURE) | (words >= 6))


def within_distance(a: Column, b: Column, distance: int = 2) -> Column:
    """Whether the edit distance, letters' case aside, is at most ``distance``."""
    return F.levenshtein(F.lower(a), F.lower(b), distance) >= 0
