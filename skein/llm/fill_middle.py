"""Fill-in-the-middle documents by markers put between units, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name

#: Ends a unit. Where a text has the character itself, it is escaped.
DELIMITER, ESCAPE = "\x01", "\x02"
#: What the escape character and the delimiter become; the digit keeps each of them one unit.
ESCAPED = {ESCAPE: ESCAPE + "0", DELIMITER: ESCAPE + "1"}
#: A unit of an escaped text: an escaped character, a run of A-Z and a-z, or any other character.
UNIT = rf"{ESCAPE}[01]|[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those that are rearranged; of those, the ones that give the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def escape(text: Column) -> Column:
    """The delimiter does not occur in what comes out."""
    for character, spelled in ESCAPED.items():
        text = F.replace(text, F.lit(character), F.lit(spelled))
    return text


def unescape(marked: Column) -> Column:
    """Takes delimiters out and gives escaped characters back."""
    text = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    for character, spelled in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(spelled), F.lit(character))
    return text


def draws(key: Column) -> list[Column]:
    """Four numbers under 2**32 that depend on ``key`` alone: the head of a SHA-256."""
    head = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(head, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Adds n, form, prefix, middle, suffix and output to the columns of ``docs``.

    A text is cut into units (``UNIT``); two numbers drawn from its id place the cuts between
    prefix, middle and suffix. The delimiter is escaped, a regular expression appends it after
    each unit, what that adds in length is the number of units, and ``substring_index`` takes the
    units before the first cut, between the cuts and after the second. They are unescaped and put
    behind ``markers`` (of prefix, suffix, middle; letters and digits between ``<`` and ``>``).

    form is ``psm``, or ``spm`` for ``suffix_first`` of 100 rearranged texts. ``100 - rate`` of 100
    texts, empty ones and those that hold a marker are ``plain``: output is the text and prefix,
    middle and suffix are null. Null texts count as empty, null ids as an empty string. Repeated
    rows come out alike. A column of the input that has one of the added names is replaced, like
    ``withColumn`` does. An empty table gives no rows. Nothing is shuffled.
    """
    names = ["text", "escaped", "marked", "h", "n", "low", "high"]
    aside = {}
    for name in names:
        aside[name] = fresh_name(docs, f"_fim_{name}")
    of = {name: F.col(f"`{c}`") for name, c in aside.items()}
    first, last, insert = markers
    rows = docs.withColumns(
        {
            aside["text"]: F.coalesce(F.col(f"`{text_col}`"), F.lit("")),
            aside["h"]: F.array(*draws(F.col(f"`{id_col}`"))),
        }
    )
    rows = rows.withColumn(aside["escaped"], escape(of["text"]))
    rows = rows.withColumn(aside["marked"], F.regexp_replace(of["escaped"], UNIT, f"$0{DELIMITER}"))
    rows = rows.withColumn(aside["n"], F.octet_length(of["marked"]) - F.octet_length(of["escaped"]))
    cuts = [of["h"][i] % (of["n"] + 1) for i in range(2)]
    rows = rows.withColumns(
        {aside["low"]: F.least(*cuts).cast("int"), aside["high"]: F.greatest(*cuts).cast("int")}
    )
    held = F.lit(False)
    for marker in markers:
        held = held | F.contains(of["text"], F.lit(marker))
    plain = (of["text"] == "") | held | (of["h"][2] % 100 >= rate)
    form = F.when(plain, "plain").when(of["h"][3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"n": of["n"].cast("long"), "form": form})

    def part(found: Column) -> Column:
        return F.when(F.col("form") != "plain", unescape(found))

    before_high = units_before(of["marked"], of["high"])
    rows = rows.withColumns(
        {
            "prefix": part(units_before(of["marked"], of["low"])),
            "middle": part(units_after(before_high, of["high"] - of["low"])),
            "suffix": part(units_after(of["marked"], of["n"] - of["high"] + 1)),
        }
    )
    parts = {first: F.col("prefix"), last: F.col("suffix"), insert: F.col("middle")}

    def assembled(order: tuple[str, ...]) -> Column:
        return F.concat(*[x for m in order for x in (F.lit(m), parts[m])])

    output = (
        F.when(F.col("form") == "psm", assembled((first, last, insert)))
        .when(F.col("form") == "spm", assembled((last, first, insert)))
        .otherwise(of["text"])
    )
    return rows.withColumn("output", output).drop(*aside.values())


def units_before(marked: Column, n: Column) -> Column:
    """The first ``n`` units, without the delimiter after the last of them."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), n)


def units_after(marked: Column, n: Column) -> Column:
    """What follows the ``n``-th delimiter from the end; everything where there are fewer."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), -n)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``fill_middle`` made ``output`` from, by output and form alone. Null gives null."""
    first, last, insert = markers

    def rebuilt(one: str, two: str) -> Column:
        body = F.substring(output, len(one) + 1, 2**31 - 1)
        rest = F.substring_index(body, two, -1)
        head, mid = F.substring_index(rest, insert, 1), F.substring_index(rest, insert, -1)
        lead = F.substring_index(body, two, 1)
        return F.concat(lead, mid, head) if one == first else F.concat(head, mid, lead)

    return F.when(form == "psm", rebuilt(first, last)).when(form == "spm", rebuilt(last, first)).otherwise(output)
