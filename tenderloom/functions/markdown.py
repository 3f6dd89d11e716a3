"""Row-local work on the Markdown text of one document, as JVM expressions.

Headings are handled by marking: a heading line gets a private-use mark with its type in front of it, the order of
the marks decides the levels, and each mark is then turned into `# `, `## ` or nothing. No character positions and no
per-line loops are needed, so a document stays one row of one stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import WS, pattern, replace_matches, strip, strip_chars

_OPEN, _CLOSE = "", ""
_MARK = f"{_OPEN}([^{_CLOSE}]+){_CLOSE}"


# ---------------------------------------------------------------- front matter
def front_matter(c: Column) -> Column:
    """Leading `---` block as a map, and the body after it."""
    block = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 0)
    inner = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(inner, "\n", -1), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"),
            strip_chars(strip(F.regexp_replace(x, r"\A[^:]*:", "")), "\"'").alias("value"),
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]),
    )
    return F.struct(
        F.map_from_entries(last).alias("meta"), F.substring(c, F.length(block) + 1, F.length(c)).alias("body")
    )


def split_front_matter(c: Column) -> Column:
    """Front matter as raw text: what stands between the first two `---`, if nothing precedes them."""
    parts = F.split(c, "---", 3)
    present = (F.size(parts) >= 3) & (strip(parts[0]) == "")
    return F.struct(
        F.when(present, parts[1]).alias("front"), F.when(present, F.get(parts, F.lit(2))).otherwise(c).alias("body")
    )


def pages(body: Column) -> Column:
    """(page, content) in order, cut at the page markers; without markers everything is page 1."""
    marker = r"<<PAGE:\s*\d+>>"
    numbers = F.regexp_extract_all(body, F.lit(pattern(fixed.PAGE_MARKER_PATTERN)), F.lit(1))
    texts = F.slice(F.split(body, pattern(marker), -1), 2, F.size(numbers) + 1)
    cut = F.zip_with(
        numbers, texts, lambda n, t: F.struct(n.cast("int").alias("page"), strip(t).alias("content"))
    )
    whole = F.array(F.struct(F.lit(1).alias("page"), strip(body).alias("content")))
    return F.when(F.size(numbers) == 0, whole).otherwise(cut)


# ---------------------------------------------------------------- cleaning
def _plain_bullets(c: Column) -> Column:
    c = F.regexp_replace(c, pattern(rf"^(\s*)[{fixed.CLEAN_BULLETS}]\s*", True), "$1- ")
    return F.regexp_replace(c, pattern(rf"^(\s*)`[{fixed.CLEAN_BULLETS}]`\s*", True), "$1- ")


def without_bold(c: Column) -> Column:
    return F.regexp_replace(c, r"(?d)\*\*(.+?)\*\*", "$1")


def _without_running_heads(c: Column) -> Column:
    for regex in fixed.RUNNING_HEAD_PATTERNS:
        c = F.regexp_replace(c, pattern(regex, True), "")
    return c


def _tidy_space(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), r"(?md)[ \t]+$", "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_for_chunks(c: Column) -> Column:
    """Bullets, bold, running heads and spacing; headings stay."""
    return _tidy_space(_without_running_heads(without_bold(_plain_bullets(c))))


def clean_page(c: Column, file_type: Column) -> Column:
    """The full cleaning: also heading marks, and for HWP the rule lines. Tables are expected to be flat already."""
    text = F.regexp_replace(without_bold(_plain_bullets(c)), pattern(r"^#{1,6}\s+", True), "")
    is_hwp = F.lower(file_type) == "hwp"
    text = F.when(is_hwp, F.regexp_replace(text, pattern(fixed.RULE_LINE_PATTERN, True), "")).otherwise(text)
    return strip(_tidy_space(_without_running_heads(text)))


# ---------------------------------------------------------------- repairs of extracted text
def join_spaced_letters(c: Column) -> Column:
    """Close up Korean syllables set apart by blanks, unless the text would shrink by more than the safe ratio."""
    spaced = r"(?:[가-힣]\s){2,}[가-힣]"
    joined = replace_matches(c, pattern(spaced), lambda hit: F.replace(hit, F.lit(" "), F.lit("")))
    shrink = (F.length(c) - F.length(joined)) / F.greatest(F.length(c), F.lit(1))
    return F.when(shrink > fixed.SPACING_RATIO, c).otherwise(joined)


def star_bullets(c: Column) -> Column:
    return F.regexp_replace(c, pattern(rf"^(\s*)[{fixed.AUDIT_BULLETS}]\s*", True), "$1* ")


def join_bold(line: Column) -> Column:
    """Merge neighbouring bold spans of a line. Each pass halves their number, so the passes follow from the count."""
    spans = F.greatest(F.regexp_count(line, F.lit(r"\*\*")) / 2, F.lit(1.0))
    passes = F.sequence(F.lit(0), F.ceil(F.log2(spans)).cast("int") + 1)
    merged = F.aggregate(
        passes, line, lambda text, _: F.regexp_replace(text, r"(?Ud)\*\*(.+?)\*\*\s*\*\*(.+?)\*\*", "**$1 $2**")
    )
    return F.when(F.contains(line, F.lit("**")), merged).otherwise(line)


def roman_with_dot(line: Column) -> Column:
    return F.regexp_replace(line, pattern(r"\A" + fixed.ROMAN_WITHOUT_DOT_PATTERN[1:]), "$1. $2")


def replacement_char_to_space(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=[가-힣A-Za-z0-9])�(?=[가-힣A-Za-z0-9])", " ")


def roman_paragraph(line: Column, starts_paragraph: Column) -> Column:
    """A paragraph that opens with a Roman numeral gets `numeral. text`, bold as a whole if it was."""
    text = strip(line)
    plain = without_bold(text)
    numeral = F.regexp_extract(plain, pattern(fixed.ROMAN_HEAD_PATTERN), 1)
    rest = strip(F.regexp_extract(plain, pattern(fixed.ROMAN_HEAD_PATTERN), 2))
    headed = F.concat(numeral, F.lit(". "), rest)
    bold = F.startswith(text, F.lit("**")) & F.endswith(text, F.lit("**"))
    changed = F.when(bold, F.concat(F.lit("**"), headed, F.lit("**"))).otherwise(headed)
    return F.when(starts_paragraph & (numeral != ""), changed).otherwise(line)


def without_parser_heading(line: Column) -> Column:
    return F.regexp_replace(line, pattern(r"\A#+\s"), "")


# ---------------------------------------------------------------- headings of a line
def line_heading_type(line: Column) -> Column:
    """Heading type of one line by the first matching pattern, brackets excluded; null if it is no heading."""
    text = strip(line)
    kind = F.lit(None).cast("string")
    for name, regex in reversed(fixed.HEADING_PATTERNS.items()):
        if name == "bracket":
            continue
        value = (
            F.concat(F.lit("제N"), F.regexp_extract(text, pattern(fixed.LEGAL_TYPE_PATTERN), 1))
            if name == "legal"
            else F.lit(name)
        )
        kind = F.when(text.rlike(pattern(rf"\A(?:{regex})$")), value).otherwise(kind)
    # Every pattern but the brackets' opens with one of these; most lines end here, without a look at their whole text.
    opens = F.substring(text, 1, 1).rlike(pattern(r"[\dIVXivxⅠ-Ⅻⅰ-ⅻ가-하]"))
    skipped = ~opens | (text == "") | text.rlike(pattern(r"\A<<PAGE:\s*\d+>>")) | F.startswith(text, F.lit("|"))
    return F.when(~skipped, kind)


def valid_letter_heading(line: Column, kind: Column) -> Column:
    """Letter headings count only with the fourteen plain marker syllables."""
    return (kind != "korean_letter") | F.contains(F.lit(fixed.LETTER_MARKERS), F.substring(strip(line), 1, 1))


def heading_title_key(title: Column) -> Column:
    """A heading title without dot leaders and a trailing page number, for comparing contents and body."""
    text = F.regexp_replace(strip(title), fixed.TOC_SEPARATOR_PATTERN, "")
    text = F.regexp_replace(text, pattern(r"\s+\d+\s*$"), "")
    return strip(F.regexp_replace(text, WS + "+", " "))


# ---------------------------------------------------------------- headings of a document
def _mark(kind: str) -> str:
    return f"{_OPEN}{kind}{_CLOSE}"


def mark_headings(c: Column) -> Column:
    """Put a type mark before every heading after the first page, the more specific pattern first."""
    first_page = F.regexp_extract(c, pattern(r"(?s)\A.*?(?=<<PAGE:\s*0*2>>)"), 0)
    text = F.substring(c, F.length(first_page) + 1, F.length(c))
    for name, regex in fixed.HEADING_PATTERNS.items():
        if name == "legal":
            typed = regex.replace("[장절조편항]", "([장절조편항])", 1)
            text = F.regexp_replace(text, pattern(f"^({typed})$", True), f"{_OPEN}$2{_CLOSE}$1")
        else:
            text = F.regexp_replace(text, pattern(f"^({regex})$", True), _mark(name) + "$1")
    return F.concat(first_page, text)


def heading_types(marked: Column) -> Column:
    """Types of the marked headings, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(marked, F.lit(_MARK), F.lit(1)))


def drop_early_brackets(marked: Column, types: Column) -> Column:
    """Bracket headings stay only after the last heading of the top type."""
    bracket, out = F.lit(_mark("bracket")), marked
    legal_seen = [F.array_contains(types, F.lit(u)) for u in fixed.LEGAL_UNITS]
    other = F.get(F.filter(types, lambda t: (t != "bracket") & ~t.isin(fixed.LEGAL_UNITS)), F.lit(0))
    candidates = [*zip(fixed.LEGAL_UNITS, legal_seen)]
    candidates += [(k, other == k) for k in fixed.HEADING_PATTERNS if k not in ("legal", "bracket")]
    for kind, is_top in reversed(candidates):
        after = F.substring_index(marked, _mark(kind), -1)
        before = F.substring(marked, F.lit(1), F.length(marked) - F.length(after))
        out = F.when(is_top, F.concat(F.replace(before, bracket, F.lit("")), after)).otherwise(out)
    return F.when(F.array_contains(types, F.lit("bracket")), out).otherwise(marked)


def heading_prefixes(original: Column, types: Column) -> dict[str, Column]:
    """For every type the mark `# `, `## ` or nothing that its level gives.

    Legal units rank in their own order, the other types follow in order of appearance, below levels that headings
    already in the text occupy; brackets are always first level.
    """
    legal = F.filter(F.array(*[F.lit(u) for u in fixed.LEGAL_UNITS]), lambda u: F.array_contains(types, u))
    other = F.filter(types, lambda t: (t != "bracket") & ~t.isin(fixed.LEGAL_UNITS))
    taken = (
        F.when(F.size(legal) >= 2, F.size(legal))
        .when(original.rlike(r"(?md)^## "), F.lit(2))
        .when(original.rlike(r"(?md)^# "), F.greatest(F.size(legal), F.lit(1)))
        .otherwise(F.size(legal))
    )
    out = {}
    for kind in [*fixed.LEGAL_UNITS, *[k for k in fixed.HEADING_PATTERNS if k != "legal"]]:
        if kind == "bracket":
            level = F.lit(1)
        elif kind in fixed.LEGAL_UNITS:
            level = F.array_position(legal, F.lit(kind))
        else:
            level = taken + F.array_position(other, F.lit(kind))
        out[kind] = F.when(level == 1, F.lit("# ")).when(level == 2, F.lit("## ")).otherwise(F.lit(""))
    return out


def replace_marks(marked: Column, prefixes: dict[str, Column]) -> Column:
    for kind, prefix in prefixes.items():
        marked = F.replace(marked, F.lit(_mark(kind)), prefix)
    return marked


def without_page_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, pattern(r"<<PAGE:\s*\d+>>"), ""))


def last_page(c: Column) -> Column:
    """The highest page number marked in a text; null without markers."""
    return F.array_max(F.regexp_extract_all(c, F.lit(pattern(fixed.PAGE_MARKER_PATTERN)), F.lit(1)).cast("array<int>"))


def only_headings(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: F.startswith(x, F.lit("#")))
