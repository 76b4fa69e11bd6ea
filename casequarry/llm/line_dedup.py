"""Line dedup with content-defined chunks.

The lines of a document are hashed, and a rolling hash runs over each line and the one before it. A
line begins a chunk where its rolling hash is a local minimum, smaller than the one before and no
larger than the one after, so boundaries depend on the lines around them only: text inserted
elsewhere shifts no boundary, and between two boundaries there are at least two lines.

A chunk that repeats is a hit, and a hit grows line by line to the ends of the repeated passage: by windows of
``min_lines`` lines that aren't blank, with the blank ones between them, each of which repeats as well. A run of repeated
lines goes if a repeated chunk lies in it. So a heading or two that happen to follow each other elsewhere stay.
A chunk that stands at the edge of a passage reaches beyond it, and a short passage may hold no whole chunk; so a run
goes as well if it has more than ``long_line`` words, and a line of more words than that is a run by itself.

Pieces (chunks, windows, long lines) that occur more than once in the whole table are kept where they first occur (by
doc_id, then position) and are hits elsewhere. They are counted by 128 bits of hash, and only those seen twice are then
grouped by their very bytes, which decide. Groups are summed up on each executor before anything is
shuffled, and what comes out is one row a distinct piece: where it is alone, or where to keep it. So a
passage that stands in a third of all documents meets nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casequarry.llm.common import columns_of, fresh, hashable

MIN_LINES = 2
#: A line of more words than this is a piece by itself.
LONG_LINE = 50
WORD = r"[^\x20\x09-\x0D]+"

#: A piece is named by its first line in the upper half of a long and its number of lines in the lower.
START, LINES = "int(shiftrightunsigned({0}, 32))", "int({0} & 4294967295)"
CODE = "(shiftleft(bigint({0}), 32) | bigint({1}))"
PLACE = ("none", "id", "of")
#: Whether a line isn't blank.
SAYS = r"{0} RLIKE r'\S'"


def _slice(array: str, code: str) -> str:
    return f"slice({array}, {START.format(code)} + 1, {LINES.format(code)})"


def pieces(text: str, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> str:
    """SQL for the lines of a text, its chunks, and the pieces that are removed where they repeat.

    ``lines`` array<string>; ``chunks`` array<long> of codes; ``all`` array of code and two hashes of each piece. A chunk
    with fewer than ``min_lines`` lines that aren't blank is none.
    """
    rolled = "transform(v.h, (x, i) -> CASE WHEN i = 0 THEN x ELSE x ^ (shiftleft(get(v.h, i - 1), 1) | shiftrightunsigned(get(v.h, i - 1), 63)) END)"
    falls = "get(r, i) < get(r, i - 1) AND coalesce(get(r, i) <= get(r, i + 1), true)"
    starts = f"transform(array({rolled}), r -> filter(sequence(0, size(r) - 1), i -> i = 0 OR ({falls})))[0]"
    chunks = f"transform(array({starts}), s -> transform(s, (x, i) -> {CODE.format('x', 'coalesce(get(s, i + 1), size(lines)) - x')}))[0]"
    windows = f"CASE WHEN size(v.b) >= {min_lines} THEN transform(sequence(0, size(v.b) - {min_lines}), j -> {CODE.format('v.b[j]', f'v.b[j + {min_lines - 1}] - v.b[j] + 1')}) ELSE cast(array() AS array<bigint>) END"
    longs = f"transform(filter(v.b, i -> length(lines[i]) > {2 * long_line} AND regexp_count(lines[i], r'{WORD}') > {long_line}), i -> {CODE.format('i', 1)})"
    whole = f"filter(chunks, c -> size(filter({_slice('lines', 'c')}, x -> {SAYS.format('x')})) >= {min_lines})"
    every = f"transform(array_distinct(concat({whole}, {windows}, {longs})), c -> named_struct('code', c, 'hi', xxhash64({_slice('v.h', 'c')}), 'lo', xxhash64({_slice('v.g', 'c')}, 7)))"
    inner = f"transform(array({chunks}), chunks -> named_struct('lines', lines, 'chunks', chunks, 'all', {every}))[0]"
    says = f"filter(sequence(0, size(lines) - 1), i -> {SAYS.format('lines[i]')})"
    hashed = f"named_struct('h', transform(lines, x -> xxhash64(x)), 'g', transform(lines, x -> xxhash64(x, 7)), 'b', {says})"
    return f"transform(array(split({text}, '\\n', -1)), lines -> transform(array({hashed}), v -> {inner})[0])[0]"


def runs(lines: str, hits: str, chunks: str, long_line: int = LONG_LINE) -> str:
    """SQL for the codes of the runs that go: of adjoining lines of pieces that are hits, with a chunk among the hits or enough words.

    A run's and a chunk's first lines are sorted together, each chunk after the run that it lies in.
    """
    covered = f"array_sort(array_distinct(flatten(transform({hits}, c -> sequence({START.format('c')}, {START.format('c')} + {LINES.format('c')} - 1)))))"
    firsts = "filter(u, (x, i) -> i = 0 OR get(u, i - 1) < x - 1)"
    lasts = "filter(u, (x, i) -> coalesce(get(u, i + 1) > x + 1, true))"
    every = f"transform(array({covered}), u -> zip_with({firsts}, {lasts}, (a, z) -> {CODE.format('a', 'z - a + 1')}))[0]"
    wordy = f"filter(r, c -> regexp_count(array_join({_slice(lines, 'c')}, '\n'), r'{WORD}') > {long_line})"
    among = f"array_sort(concat(transform(r, c -> {CODE.format('2 * ' + START.format('c'), LINES.format('c'))}), transform(array_intersect({chunks}, {hits}), c -> {CODE.format('2 * ' + START.format('c') + ' + 1', 0)})))"
    is_chunk = "(shiftrightunsigned({0}, 32) & 1) = 1"
    led = f"transform(array({among}), m -> filter(m, (x, i) -> NOT {is_chunk.format('x')} AND coalesce({is_chunk.format('get(m, i + 1)')}, false)))[0]"
    with_chunk = f"transform({led}, x -> {CODE.format('int(shiftrightunsigned(x, 33))', LINES.format('x'))})"
    return f"transform(array({every}), r -> array_union({with_chunk}, {wordy}))[0]"


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, counts: tuple[str, str, str] = ("__chunks", "__removed_chunks", "__removed_lines")) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated passages removed from the texts.

    Adds three int columns named by ``counts`` (0 for a null text), replacing columns of these names; ``n_chars``,
    if there, follows the text. Lines end at ``\\n``. A null text stays null; a document all of whose lines
    are repeats keeps its row with an empty text; blank lines alone are never removed, and a run
    of equal lines may shrink to one. Of a piece that repeats within one document the first stays. Rows
    that share an id only are placed by their texts' hashes; of rows that share id and text the first
    keeps its pieces. Null ids come first. An empty table gives no rows.
    """
    columns = [name for name in docs.columns if name not in counts]
    none, id_, of, piece, unique, repeated, kept, copy, result = fresh(docs, *PLACE, "piece", "unique", "repeated", "kept", "copy", "result")
    place = [none, id_, of]
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), of: F.coalesce(F.xxhash64("text"), F.lit(0))})
    cut_up = F.expr(pieces("text", min_lines, long_line))
    first = F.min(F.struct(~F.col(none), F.col(id_), F.col(of), F.col(f"{piece}.code").alias("code"))).alias("at")

    def listed(firsts: DataFrame, name: str) -> DataFrame:
        at = firsts.select((~F.col("at.col1")).alias(none), F.col(f"at.{id_}").alias(id_), F.col(f"at.{of}").alias(of), "at.code")
        return at.groupBy(*place).agg(F.collect_list("code").alias(name))

    slim = keyed.where("text IS NOT NULL").select(*place, F.explode(cut_up["all"]).alias(piece))
    alone = slim.groupBy(f"{piece}.hi", f"{piece}.lo").agg(first, F.count("*").alias("n")).where("n = 1")
    marked = keyed.join(listed(alone, unique), place, "left").withColumn(piece, cut_up)
    again = F.array_except(F.transform(f"{piece}.all", lambda p: p["code"]), F.coalesce(unique, F.array().cast("array<long>")))
    marked = marked.withColumn(repeated, again)
    texts = F.expr(f"transform({repeated}, c -> named_struct('code', c, 'bytes', array_join({_slice(f'{piece}.lines', 'c')}, '\\n')))")
    # asks for every column, as the result does, so that one shuffle of the texts serves both
    every = F.xxhash64(*hashable(keyed)) == 0
    spelt = marked.where((F.size(repeated) > 0) | every).select(*place, F.explode(texts).alias(piece))
    keeps = listed(spelt.groupBy(f"{piece}.bytes").agg(first), kept)
    joined = marked.join(keeps, place, "left").withColumn(copy, F.row_number().over(Window.partitionBy(*place).orderBy(of)))
    own = F.when(F.col(copy) == 1, F.col(kept))
    gone = F.array_except(repeated, F.coalesce(own, F.array().cast("array<long>")))
    out = joined.withColumn(kept, gone).withColumn(repeated, F.expr(runs(f"{piece}.lines", kept, f"{piece}.chunks", long_line)))
    out = out.withColumn(unique, F.expr(f"flatten(transform({repeated}, c -> sequence({START.format('c')}, {START.format('c')} + {LINES.format('c')} - 1)))"))
    text = F.expr(f"array_join(transform(array_except(sequence(0, size({piece}.lines) - 1), {unique}), i -> {piece}.lines[i]), '\\n')")
    chunks = F.array_intersect(f"{piece}.chunks", kept)
    found = F.when(F.col("text").isNotNull(), F.struct(text.alias("text"), F.size(f"{piece}.chunks").alias("chunks"), F.size(chunks).alias("removed"), F.size(unique).alias("lines")))
    out = out.withColumn(result, found)
    new = {"text": F.col(f"{result}.text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(f"{result}.text").cast(docs.schema["n_chars"].dataType))
    return out.select(
        *[new[name].alias(name) if name in new else column for name, column in zip(columns, columns_of(columns), strict=True)],
        *[F.coalesce(f"{result}.{part}", F.lit(0)).alias(name) for part, name in zip(("chunks", "removed", "lines"), counts, strict=True)],
    )
