"""Text expressions over columns: all built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns for white space as Python's str methods see it, and the fence of a code block.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINES = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
FENCE = r"(?is)```(?:json)?\s*(.*?)```"

# Wording of labels.
NEW_EXAM = "새 시험지"
UNTITLED = "(제목 없음)"
NO_STEM = "(발문 없음)"
UNSPECIFIED = "(미지정)"
UNRATED = "미분류"
DIRECT_INPUT = "직접 입력"
LEVEL_NAMES = {1: "1단계 (최하)", 2: "2단계 (하)", 3: "3단계 (중)", 4: "4단계 (상)", 5: "5단계 (최상)"}
LEVEL_COLOURS = {None: "#9e9e9e", 1: "#43a047", 2: "#7cb342", 3: "#fbc02d", 4: "#fb8c00", 5: "#e53935"}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def lines(text: Column) -> Column:
    """The lines of a text; an empty last one is none."""
    parts = F.split(text, LINES)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def or_else(text: Column, placeholder: str) -> Column:
    """The text, or a placeholder where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(placeholder))


def clamp(level: Column) -> Column:
    """1 to 5; null stays null, which greatest and least alone would turn into a bound."""
    return F.when(level.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), level))).cast("int")


def type_name(kind: Column) -> Column:
    return or_else(kind, UNSPECIFIED)


def filled(*given: Column) -> Column:
    """The first of the texts that isn't blank, stripped; else the empty one."""
    return F.coalesce(*(F.nullif(strip(x), F.lit("")) for x in given), F.lit(""))


def display_title(title: Column, text: Column) -> Column:
    own = strip(F.coalesce(title, F.lit("")))
    first = F.coalesce(F.get(F.split(strip(F.coalesce(text, F.lit(""))), LINES), 0), F.lit(""))
    return F.when(own != "", own).otherwise(or_else(shortened(first, 30), UNTITLED))


def level_label(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(0)) != 0, F.concat(F.lit("Lv."), level.cast("string"))).otherwise(F.lit(UNRATED))


def passage_label(level: Column, title: Column, kind: Column, n_questions: Column) -> Column:
    shown = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit(" · "), kind)).otherwise(F.lit(""))
    return F.concat(F.lit("["), level_label(level), F.lit("] "), title, shown, F.lit("  ("), n_questions.cast("string"), F.lit("문항)"))


def editor_label(level: Column, title: Column, n_questions: Column) -> Column:
    return passage_label(level, title, F.lit(""), n_questions)


def question_number(number: Column, index: Column) -> Column:
    """The question's own number, or its place from 1."""
    return F.coalesce(F.nullif(number, F.lit("")), (index + 1).cast("string"))


def question_label(number: Column, index: Column, stem: Column) -> Column:
    one = F.replace(strip(F.coalesce(stem, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.concat(question_number(number, index), F.lit(". "), or_else(shortened(one, 24), NO_STEM))


def source_label(file: Column, pages: Column) -> Column:
    listed = F.array_join(F.transform(F.coalesce(pages, F.array()), lambda p: p.cast("string")), ", ")
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(file, F.when(listed != "", F.concat(F.lit(" (p."), listed, F.lit(")"))).otherwise(F.lit("")))).otherwise(F.lit(DIRECT_INPUT))


def _of_level(level: Column, values: dict[int, str], otherwise: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, level.cast("int")), F.lit(otherwise))


def level_name(level: Column) -> Column:
    return _of_level(level, LEVEL_NAMES, UNRATED)


def level_colour(level: Column) -> Column:
    return _of_level(level, {k: v for k, v in LEVEL_COLOURS.items() if k}, LEVEL_COLOURS[None])


def badge(level: Column) -> Column:
    return F.concat(F.lit('<span style="background:'), level_colour(level), F.lit(';color:white;padding:1px 6px;border-radius:3px;">'), level_label(level), F.lit("</span>"))


def html_escape(text: Column) -> Column:
    """Null gives the empty text; line feeds become breaks."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def preview(title: Column, level: Column, kind: Column, text: Column, questions: Column) -> Column:
    """A passage as HTML; title is the shown one."""

    # The markup of a preview.
    def question(q: Column, i: Column) -> Column:
        number = question_number(q["number"], i)
        rated = F.when(F.coalesce(q["difficulty"], F.lit(0)) != 0, badge(q["difficulty"])).otherwise(F.lit(""))
        head = F.concat(F.lit('<p style="margin-top:10px;"><b>'), html_escape(number), F.lit(".</b> "), html_escape(q["stem"]), F.lit(" "), rated, F.lit("</p>"))
        choices = F.array_join(F.transform(q["choices"], html_escape), "<br>")
        listed = F.concat(F.lit("<div style='margin-left:14px;'>"), choices, F.lit("</div>"))
        return F.concat(head, F.when(F.coalesce(F.size(q["choices"]), F.lit(0)) > 0, listed).otherwise(F.lit("")))

    shown = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit('<div style="color:#607d8b;">'), html_escape(kind), F.lit("</div>"))).otherwise(F.lit(""))
    body = F.concat(F.lit('<div style="border:1px solid #cfd8dc;padding:8px;margin:6px 0;line-height:150%;">'), html_escape(text), F.lit("</div>"))
    return F.concat(F.lit("<h3>"), html_escape(title), F.lit(" "), badge(level), F.lit("</h3>"), shown, body, F.array_join(F.transform(questions, question), ""))


def choices_of(text: Column) -> Column:
    """The stripped lines of a text that aren't blank."""
    return F.filter(F.transform(lines(text), strip), lambda c: c != "")


def text_of(choices: Column) -> Column:
    """Choices as lines."""
    return F.array_join(choices, "\n")


def one_decimal(total: Column, count: Column) -> Column:
    """total / count to one decimal, as a float's exact binary value rounds; '-' over nothing. total lies within 5 * count.

    A tie in twentieths goes where its nearest float lies, which a table tells; all else is integer arithmetic.
    """
    s, n = total.cast("long"), F.nullif(count.cast("long"), F.lit(0).cast("long"))
    twentieths = F.lit(20) * s
    tie = (F.pmod(twentieths, n) == 0) & (F.pmod((twentieths / n).cast("long"), F.lit(2)) == 1)
    ties = F.create_map(*(F.lit(x) for t in range(1, 101, 2) for x in (t, f"{t / 20:.1f}")))
    k = F.floor((twentieths + n) / (F.lit(2) * n)).cast("long")
    plain = F.concat(F.floor(k / 10).cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"))
    return F.coalesce(F.when(tie, F.try_element_at(ties, (twentieths / n).cast("int"))).otherwise(plain), F.lit("-"))


def extract_json(text: Column) -> Column:
    """JSON text out of an answer with code fences or prose around it, null where there is none."""
    cleaned = strip(text)
    fenced = F.when(F.regexp_like(cleaned, F.lit(FENCE)), strip(F.regexp_extract(cleaned, FENCE, 1))).otherwise(cleaned)
    starts = [F.locate(c, fenced) for c in ("{", "[")]
    start = F.least(*(F.when(s > 0, s) for s in starts))
    back = F.reverse(fenced)
    ends = [F.when(F.locate(c, back) > 0, F.char_length(fenced) + 1 - F.locate(c, back)) for c in ("}", "]")]
    end = F.greatest(*ends)
    inner = F.when(end > start, F.substring(fenced, start, end - start + 1))
    return F.when(F.try_parse_json(fenced).isNotNull(), fenced).when(F.try_parse_json(inner).isNotNull(), inner)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """What comes before the last slash: "." for a bare name, "/" at the root."""
    cut = F.regexp_replace(path, "/+[^/]*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def new_id() -> Column:
    """Twelve hexadecimal digits; write the frame before using them twice."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
