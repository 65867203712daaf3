"""Lines of web pages, their recurrence on each site, and what that says of each line.

The pages reach us as text, so the smallest subtree of a page is a line. Each line is hashed under a key in which names,
numbers and slots are masked, and the keys are counted per host. First the full sentences are judged: one that stands
beside many different reports of its host is furniture. The sentences that are left make up the report, so the other
lines of a page (menus, teasers, subheads, bullet points) stand inside or around it, and a second count per host
tells which keys recur around reports. Where a host has seen a key too seldom to tell, the hosts are pooled.

Sentences also fall into the leaves of a fixed-depth prefix tree of message templates. A leaf is classified once, by
the pages its sentences stand on, and the verdict is carried back to every sentence of the leaf.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.texthash import letter_class, mixed, part_hashes, string_bytes, string_hashes
from seismark.session import cut_lineage, written

#: Least number of lines of a key, or of different reports beside a sentence, that say anything.
LEAST = 3
#: Share of a host's different reports beside a sentence from which the host calls it furniture, below which it calls it
#: part of reports; between them the share of all hosts' reports decides, from ``POOLED_SHARE`` on.
HOST_SHARE, HOST_SHARE_LEAST, POOLED_SHARE = 0.02, 0.001, 0.008
#: Lines of a key on a host from which its own share inside reports decides, and the shares it must be outside of.
HOST_LINES, HOST_INSIDE = 10, (0.25, 0.65)
#: Share of a key's lines inside reports, over all hosts, from which it belongs to them.
INSIDE_SHARE = 0.45
#: A message template: least share of all pages, share of its pages with much text up to which it is one, and how much
#: text that is, against the average number of sentences of a page.
MESSAGE_PAGES, MESSAGE_SHARE, MUCH_TEXT = 3e-5, 0.05, 0.5
#: Words of a sentence, and of a text without a full stop, from which it counts as one.
SENTENCE_WORDS, UNSTOPPED_WORDS = 4, 60
#: Rows of a verdict table that are broadcast (a few bytes each); a larger table is joined by shuffle.
BROADCAST_VERDICTS = 500_000

# Notations of slots that a template engine or an editor should have filled.
SURE_SLOTS = r"\{\{\s*[\w.]+\s*\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|<<[A-Z][A-Z0-9_. ]*>>|\$\{[\w. ]{1,60}\}|@@\w[\w.]*@@|\[\[[\w. ]{1,60}\]\]|\[INSERT [^\]\n]{1,60}\]|XX[A-Z][A-Z0-9_. ]*XX|__[A-Z][A-Z0-9_. ]*__|%[A-Z][A-Z0-9_. ]+%"
POSSIBLE_SLOTS = r"(?<![\[{$])(?:\[[A-Za-z][\w. ]{1,40}\]|\{[A-Za-z][\w. ]{1,40}\})(?![\]}])"

# Words of the common filler text.
FILLER_WORDS = (
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor", "incididunt", "ut", "labore", "et", "dolore", "magna", "aliqua", "enim",
    "ad", "minim", "veniam", "quis", "nostrud", "exercitation", "ullamco", "laboris", "nisi", "aliquip", "ex", "ea", "commodo", "consequat", "duis", "aute", "irure", "in", "reprehenderit",
    "voluptate", "velit", "esse", "cillum", "eu", "fugiat", "nulla", "pariatur", "excepteur", "sint", "occaecat", "cupidatat", "non", "proident", "sunt", "culpa", "qui", "officia", "deserunt", "mollit", "anim", "id", "est", "laborum",
)

# Patterns for Arrow's regular expressions; _SLOT_MASK for Python's, since slots look around themselves.
_NAME = r"\p{Lu}[\p{L}\p{N}'’_&;-]*"
_BLANK = r"[ \t\n\x0B\f\r]"
_MASK = rf"(?:{_NAME}|\d+(?:[.,:]\d+)*)(?:{_BLANK}+{_NAME})*"
_SLOT_MASK = rf"(?:{SURE_SLOTS}|{POSSIBLE_SLOTS}|{{name}}|\d+(?:[.,:]\d+)*)(?:\s+{{name}})*"
_SLOT_MARKS = r"[{\[%]|<<|@@|__|XX"
_LABEL = rf"^(?:X[.)]|[^:.]{{1,20}}:){_BLANK}+"
_REPORT_NOTE = r"(?i)^(?:correction|clarification|corrected|editor'?s note)\b"
_SENTENCE_END = r"[.!?。！？؟]['\"”’]?$"
_BETWEEN_SENTENCES = rf"[.!?。！？؟][\"”’')\]]*{_BLANK}+"
_BLANKS = " \t\r\u00a0"
_BULLET = r"^[-•*–]"
#: Filler holds at least one of these words, in any case; pages without them are not looked at further.
FILLER_MARKS = ("dolor", *(w for w in FILLER_WORDS if len(w) > 6 or w in ("lorem", "ipsum")))
_FILLER_MARK = f"(?i){'|'.join(FILLER_MARKS)}"
_FILLER_WORD, _LATIN_WORD = re.compile(rf"\b(?:{'|'.join(FILLER_WORDS)})\b"), re.compile("[a-z]+")
#: Text of the pages that are looked at together.
_BYTES_AT_ONCE = 3_000_000


@functools.cache
def _slot_patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The mask of lines that may hold a slot, unmistakable and possible slots."""
    name = f"[{letter_class('Lu')}][{letter_class('L', 'N')}'’_&;-]*"
    return re.compile(_SLOT_MASK.replace("{name}", name), re.ASCII), re.compile(SURE_SLOTS, re.ASCII), re.compile(POSSIBLE_SLOTS, re.ASCII)


def is_filler(text: str) -> bool:
    """At least 60 % of the words of a text are filler."""
    lower = text.lower()
    return len(_FILLER_WORD.findall(lower)) >= 0.6 * len(_LATIN_WORD.findall(lower))


def _matches(strings: pa.StringArray, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)


def _lists(values: pa.Array, sizes: np.ndarray, held: np.ndarray | None = None) -> pa.ListArray:
    """Lists of successive values; null where not ``held``."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if held is None else pa.array(~held))


def _any(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each of successive groups, whether a flag is set in it."""
    ends = np.cumsum(sizes)
    so_far = np.append(0, np.cumsum(flags))
    return so_far[ends] > so_far[ends - sizes]


_UNIT = pa.struct([("leaf", pa.int64()), ("filler", pa.bool_())])
#: What ``page_cells`` says of a line.
CELL = "struct<line_no: int, sentence: boolean, key: bigint, beside: bigint, rest_key: bigint, units: array<struct<leaf: bigint, filler: boolean>>, bullet: boolean, note: boolean, sure: array<string>, possible: array<string>>"


def _units(pieces: pa.StringArray, start: np.ndarray, end: np.ndarray, spaces: np.ndarray, data: np.ndarray, wanted: np.ndarray, may_fill: np.ndarray) -> pa.StructArray:
    """The leaf of each wanted piece, of a fixed-depth prefix tree over masked sentences (the number of tokens, then the first
    three tokens), and whether it is filler. ``spaces``: where the pieces' spaces stand in ``data``."""
    start, end = start[wanted], end[wanted]
    first = np.searchsorted(spaces, start)
    words = np.searchsorted(spaces, end) - first + 1
    leaf = mixed(part_hashes(data, start, spaces[first + 2] if len(first) else first) ^ words.astype(np.uint64))
    filler = np.zeros(len(start), dtype=bool)
    look = np.flatnonzero(may_fill[wanted])
    if len(look):
        filler[look] = [is_filler(x) for x in pieces.take(pa.array(np.flatnonzero(wanted)[look])).to_pylist()]
    return pa.StructArray.from_arrays([pa.array(leaf.view(np.int64)), pa.array(filler)], fields=list(_UNIT))


def _cells_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """page, host, report, cells of pages whose text is not blank."""
    page, host, content = (batch.column(k) for k in range(3))
    by_page = pc.split_pattern(content, "\n")
    count = pc.list_value_length(by_page).to_numpy()
    line_no = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    line = pc.utf8_trim(by_page.flatten(), _BLANKS)
    held = pc.binary_length(line).to_numpy() > 0
    owner, line_no, line = np.repeat(np.arange(len(page)), count)[held], line_no[held], line.filter(pa.array(held))
    count = np.bincount(owner, minlength=len(page))

    masked = pc.replace_substring_regex(line, _MASK, "X")
    may_slot = _matches(line, _SLOT_MARKS)
    sure, possible = [None] * len(line), [None] * len(line)
    if may_slot.any():
        mask, sure_slot, possible_slot = _slot_patterns()
        texts = line.filter(pa.array(may_slot)).to_pylist()
        for i, text in zip(np.flatnonzero(may_slot).tolist(), texts):
            sure[i], possible[i] = [m.group() for m in sure_slot.finditer(text)], [m.group() for m in possible_slot.finditer(text)]
        masked = pc.replace_with_mask(masked, pa.array(may_slot), pa.array([mask.sub("X", t) for t in texts], pa.string()))
    shape = pc.if_else(pc.match_substring_regex(masked, r"\p{Ll}{2}"), masked, pc.utf8_lower(line))
    words = pc.count_substring(line, " ").to_numpy() + 1
    stopped = (words > SENTENCE_WORDS) & _matches(line, _SENTENCE_END)
    code = np.where(stopped, string_hashes(line), np.uint64(0))

    by_line = pc.split_pattern_regex(shape, _BETWEEN_SENTENCES)
    parts, pieces = pc.list_value_length(by_line).to_numpy(), by_line.flatten()
    data, at = string_bytes(pieces)
    spaces = np.flatnonzero(data == 32)
    piece_words = np.diff(np.searchsorted(spaces, at)) + 1
    last = np.zeros(len(pieces), dtype=bool)
    last[np.cumsum(parts) - 1] = True
    sentence = stopped | _any((piece_words > SENTENCE_WORDS) & ~last, parts) | (words >= UNSTOPPED_WORDS)
    wanted = np.repeat(sentence, parts) & (piece_words >= SENTENCE_WORDS)
    units = _units(pieces, at[:-1], at[1:], spaces, data, wanted, np.repeat(_matches(content, _FILLER_MARK)[owner], parts))
    in_line = np.bincount(np.repeat(np.arange(len(line)), parts)[wanted], minlength=len(line))

    # The hash of all sentences together, so that one of them can be taken out again.
    report = np.bitwise_xor.reduceat(code, np.cumsum(count) - count) if len(page) else code
    report = np.where(report != 0, report, string_hashes(page.cast(pa.string()).fill_null("")))
    key, label = string_hashes(shape), _matches(shape, _LABEL)
    rest = np.zeros(len(line), dtype=np.uint64)
    rest[label] = string_hashes(pc.replace_substring_regex(shape.filter(pa.array(label)), _LABEL, "", max_replacements=1))
    cells = {
        "line_no": pa.array(line_no, pa.int32()),
        "sentence": pa.array(sentence),
        "key": pa.array(key.view(np.int64)),
        "beside": pa.array((report[owner] ^ code).view(np.int64), mask=~sentence),
        "rest_key": pa.array(rest.view(np.int64), mask=~label),
        "units": _lists(units, in_line, sentence),
        "bullet": pc.match_substring_regex(line, _BULLET),
        "note": pc.match_substring_regex(line, _REPORT_NOTE),
        "sure": pa.array(sure, pa.list_(pa.string())),
        "possible": pa.array(possible, pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_arrays([page, host, pa.array(report.view(np.int64)), _lists(pa.StructArray.from_arrays(list(cells.values()), list(cells)), count)], ["page", "host", "report", "cells"])


def page_cells(pages: DataFrame, page: str, host: str, text: str) -> DataFrame:
    """page, host, report, cells: one row per page, with its non-blank lines; pages without text give none.

    Of each line there is its key, whether it is a sentence, of each of its sentences the template's leaf and whether it is
    filler (``units``), and a hash of the page's other sentences (``beside``). ``report`` hashes all of them. Patterns run
    over whole columns of lines in Arrow, for which they need no more than a tenth of the time of expressions per line.
    """
    base = pages.select(F.col(page).alias("page"), F.col(host).alias("host"), F.col(text).alias("content")).where(F.trim("content", F.lit(_BLANKS + "\n")) != "")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)) // _BYTES_AT_ONCE
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                yield _cells_of(batch.slice(start, end - start))

    kinds = dict(base.dtypes)
    return base.mapInArrow(cells, f"page {kinds['page']}, host {kinds['host']}, report bigint, cells array<{CELL}>")


def checked_broadcast(table: DataFrame, bound: int = BROADCAST_VERDICTS) -> DataFrame:
    """A checkpointed table, marked for broadcast if its row count is within the bound."""
    return F.broadcast(table) if table.count() <= bound else table


def _spread(expected: Column | float) -> Column | float:
    """A count that chance reaches hardly ever where ``expected`` is the limit: twice the spread above it."""
    return expected + 2 * (F.sqrt(expected) if isinstance(expected, Column) else math.sqrt(expected))


def recurring_sentences(cells: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(host, furniture_keys, report_keys), (pooled_keys) and the number of different reports: sentences that recur.

    Lines are counted per key and host before the hosts meet, so one host or line with a third of all rows is a few
    partial counts per task. A sentence recurs as often as different reports stand beside it: copies of one report count
    once per host, and so do they among the host's pages. The lists are short: what recurs on a share s of the pages can
    be no more than the lines of a page over s.
    """
    lines = cells.select("host", F.explode("cells").alias("cell")).where("cell.sentence").select("host", "cell.key", "cell.beside")
    # Most sentences stand once in the corpus. They can be none of the hosts' and need not be kept.
    per_host = cut_lineage(lines.groupBy("host", "key").agg(F.count_distinct("beside").alias("n")).where(F.col("n") >= 2))
    hosts = checked_broadcast(cut_lineage(cells.groupBy("host").agg(F.count_distinct("report").alias("pages"))))
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    pooled = per_host.groupBy("key").agg(F.sum("n").alias("all_n")).where(F.col("all_n") >= max(LEAST, _spread(POOLED_SHARE * total))).select("key", F.lit(True).alias("pooled"))
    of_host = per_host.join(hosts, per_host["host"].eqNullSafe(hosts["host"])).select(per_host["host"], "key", "n", "pages")
    furniture = F.col("n") >= F.greatest(F.lit(LEAST), _spread(HOST_SHARE * F.col("pages")))
    report = F.col("n") + 2 * F.sqrt("n") < HOST_SHARE_LEAST * F.col("pages")
    pooled = checked_broadcast(cut_lineage(pooled))
    told = of_host.where(furniture).select("host", "key", furniture.alias("furniture")).unionByName(of_host.join(pooled, "key", "left_semi").where(report).select("host", "key", F.lit(False).alias("furniture")))
    lists = told.groupBy("host").agg(*[F.collect_list(F.when(F.col("furniture") == kind, F.col("key"))).alias(name) for name, kind in (("furniture_keys", True), ("report_keys", False))])
    return checked_broadcast(cut_lineage(lists)), cut_lineage(pooled.agg(F.collect_list("key").alias("pooled_keys"))), total


def placed_lines(cells: DataFrame, of_host: DataFrame, pooled: DataFrame) -> DataFrame:
    """One row per line: what ``page_cells`` says of it, whether it is a recurring sentence of its host, whether it is
    inside (between sentences of the report), and text, the report's number of sentences."""
    known = cells.join(of_host, cells["host"].eqNullSafe(of_host["host"]), "left").select(cells["*"], "furniture_keys", "report_keys").crossJoin(F.broadcast(pooled))

    def recurs(c: Column) -> Column:
        by_all = F.array_contains("pooled_keys", c["key"]) & ~F.coalesce(F.array_contains("report_keys", c["key"]), F.lit(False))
        return c["sentence"] & (F.coalesce(F.array_contains("furniture_keys", c["key"]), F.lit(False)) | by_all)

    # The cells stay as they are: copying each of them would take more time than all else here.
    known = known.withColumn("recurs", F.transform("cells", recurs))
    body = F.filter(F.transform("cells", lambda c, i: F.when(c["sentence"] & ~F.get("recurs", i), F.struct(c["line_no"].alias("line_no"), F.size(c["units"]).alias("units")))), lambda b: b.isNotNull())
    known = known.select("page", "host", "cells", "recurs", body.alias("body"))
    text = F.aggregate("body", F.lit(0), lambda a, b: a + b["units"])
    known = known.select("page", "host", "cells", "recurs", F.get("body", F.lit(0))["line_no"].alias("first"), F.try_element_at("body", F.lit(-1))["line_no"].alias("last"), text.alias("text"))
    lines = known.select("page", "host", "recurs", "first", "last", "text", F.posexplode("cells").alias("at", "cell"))
    lines = lines.select("page", "host", "first", "last", "text", (F.col("at") == 0).alias("opening"), F.get("recurs", F.col("at")).alias("recurring"), "cell.*")
    inside = F.coalesce((F.col("line_no") > F.col("first")) & (F.col("line_no") < F.col("last")), F.lit(False))
    return lines.withColumn("inside", inside).drop("first", "last", "beside")


def recurring_lines(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, key, host_furniture) where the host can tell, and (key, furniture) of all hosts, by where their lines stand.

    Sentences that recur are judged too: those that stand inside reports belong to them however often they occur.
    """
    per_host = placed.where("NOT sentence OR recurring").groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inside").cast("bigint")).alias("inside"))
    per_host = cut_lineage(per_host)
    share = F.col("inside") / F.col("n")
    of_host = per_host.where((F.col("n") >= HOST_LINES) & ((share < HOST_INSIDE[0]) | (share > HOST_INSIDE[1]))).select("host", "key", (share < HOST_INSIDE[0]).alias("host_furniture"))
    pooled = per_host.groupBy("key").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).where(F.col("n") >= LEAST)
    return checked_broadcast(cut_lineage(of_host)), checked_broadcast(cut_lineage(pooled.select("key", (share < INSIDE_SHARE).alias("furniture"))))


def message_templates(placed: DataFrame, pages: int) -> DataFrame:
    """(leaf, message) of the templates that recur on pages which hold little else.

    The tree is filled with every sentence that is not furniture. A leaf is a message if it stands on enough pages and
    hardly any of them has much text, against the average of the corpus.
    """
    units = placed.where("sentence AND NOT recurring").select("page", "text", F.explode("units").alias("unit")).where("NOT unit.filler")
    average = placed.where("opening").agg(F.coalesce(F.avg("text"), F.lit(0.0))).first()[0]
    per_page = units.groupBy(F.col("unit.leaf").alias("leaf"), "page").agg(F.max("text").alias("text"))
    leaves = per_page.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("text") >= MUCH_TEXT * average).cast("bigint")).alias("among_text"))
    least = max(LEAST, _spread(MESSAGE_PAGES * pages))
    messages = leaves.where((F.col("n") >= least) & (F.col("among_text") <= MESSAGE_SHARE * F.col("n"))).select("leaf", F.lit(True).alias("message"))
    return checked_broadcast(cut_lineage(messages))


def judged_lines(pages: DataFrame, page: str, host: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(page, line_no, furniture, is_unit, message), a row for each sentence of a line and one for a line without, and (page,
    line_no, furniture, sure, possible) of the lines that hold marks of slots.

    A line is furniture if its key recurs around reports, if it is a label or number before such a line, or if it is a
    title-like line that occurs too seldom to count and stands outside the report. Correction notes belong to a report.
    """
    # The text is read once: what both the counts and the verdicts need of a page is written down, without its text.
    cells = written(page_cells(pages, page, host, text))
    of_host, pooled, total = recurring_sentences(cells)
    placed = written(placed_lines(cells, of_host, pooled))
    own, keys = recurring_lines(placed)
    leaves = message_templates(placed, total)
    rest = keys.select(F.col("key").alias("rest_key"), F.col("furniture").alias("rest_furniture"))
    by_key = F.coalesce("host_furniture", "furniture")
    alone = by_key.isNull() & ~F.col("inside") & ~F.col("bullet")
    furniture = F.when(F.col("sentence"), F.col("recurring") & F.coalesce(by_key, F.lit(True))).otherwise(F.coalesce(by_key, F.lit(False)) | alone) | F.coalesce("rest_furniture", F.lit(False))

    def judged(lines: DataFrame, *more: str | Column) -> DataFrame:
        known = lines.join(own, ["host", "key"], "left").join(keys, "key", "left").join(rest, "rest_key", "left")
        return known.select("page", "line_no", (furniture & ~F.col("note")).alias("furniture"), *more)

    units = judged(placed, F.explode_outer("units").alias("unit")).select("*", F.col("unit.leaf").alias("leaf"), "unit.filler").join(leaves, "leaf", "left")
    message = F.coalesce(F.col("message") | F.col("filler"), F.col("filler"), F.lit(False))
    slots = judged(placed.where("size(sure) > 0 OR size(possible) > 0"), "sure", "possible")
    return units.select("page", "line_no", "furniture", F.col("leaf").isNotNull().alias("is_unit"), message.alias("message")), slots
