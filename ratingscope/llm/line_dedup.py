"""Removal of repeated runs of words by winnowing (operator 5).

A text is cut into words, each with the white space after it, so that a passage has the same parts wherever it is
pasted: no border of a line has to fall on its own. A gram is a run of ``run_words`` words, a window one of
``sure_words``; the least gram hash in every window is a fingerprint. So each run of ``sure_words`` words that two
texts share has a fingerprint in common, wherever it begins, and shorter ones down to ``run_words`` words may have one.

Fingerprints are joined on their hash: each later place meets the first one (the smallest id, then the
smallest position). A meeting is an alignment of two texts; it is extended both ways over equal words, and the
later text loses the run. The first place of a gram may have just the gram of a longer run that others share. So the windows
that hold a met gram and reach beyond the run are joined on their own hashes in a second step, whole windows, and all but their first place
go too. Thus no run of ``sure_words`` words stays whole in two places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingscope.llm.common import if_small, map_slices, slices, written

#: Which code points are white space, and which are marks at which a clause ends; those from 0x3001 on are neither. A line that
#: is counted ends at a line break, or in white space after such a mark.
_SPACE = np.array([chr(k).isspace() for k in range(0x3002)])
_CLAUSE = np.array([chr(k) in ".!?;:,…" for k in range(0x3002)])
#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: A source text with more meetings than this is met in several tasks, so many meetings in each: what a task compares in a few
#: seconds, since to split a source means to read the meetings and the words once more.
HOT = 10_000
#: Words that are compared at once.
PLACES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a text, which of them are white space, and where it begins and ends."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    return points, space, np.flatnonzero(space[1:] != space[:-1]) + 1


def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of a text begin, words with the white space after them, and its length; whether a line ends in each."""
    points, space, edges = _points(text)
    starts = edges[~space[edges]]
    # white space before the first word belongs to it
    starts = np.concatenate([[0], starts[1:] if len(space) and space[0] else starts, [len(points)]])
    after = edges[space[edges]]  # the white space after a word begins here
    after = after[_CLAUSE[np.minimum(points[after - 1], len(_CLAUSE) - 1)]]
    ends = np.zeros(len(starts) - 1, bool)
    for found in (np.flatnonzero(points == 10), after):
        ends[np.searchsorted(starts, found, "right") - 1] = True
    return starts, ends


def lines(text: str) -> list[str]:
    """The parts of a text, words with the white space after them; joined they are the text."""
    starts = _parts(text)[0].tolist()
    return [text[a:b] for a, b in zip(starts, starts[1:]) if a < b]


def hash_words(texts: list[str]) -> list[np.ndarray]:
    """XXH64 of each word of each text; case doesn't count. All words of one length at once."""
    texts = [t.lower() for t in texts]
    points, space, _ = _points(" ".join(texts))
    plain = points.copy()
    plain[space] = 32
    data = plain.tobytes().decode("utf-32-le").encode()
    # places of words in code points tell the texts apart, those in bytes are hashed
    borders = _borders(~space)[::2]
    stops = np.searchsorted(borders, np.cumsum([len(t) + 1 for t in texts]))
    words = _borders(np.frombuffer(data, np.uint8) != 32)
    starts, lengths = words[::2], words[1::2] - words[::2]
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    groups = np.searchsorted(lengths[order], np.arange(1, 33)).tolist()
    hashes, lanes = np.empty(len(starts), np.uint64), np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    for length in range(1, 32):
        at = order[groups[length - 1] : groups[length]]
        if len(at):
            hashes[at] = _xxh64(lanes, starts[at], length)
    for k in order[groups[31] :].tolist():
        hashes[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return np.split(hashes, stops[:-1])


def _xxh64(lanes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH64 of strings of ``length`` bytes, less than 32, that begin at ``starts``; ``lanes`` has the eight bytes from each place on."""

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    x = np.full(len(starts), _P5 + np.uint64(length))
    for at in range(0, length - 7, 8):
        x = turned(x ^ turned(lanes[starts + at] * _P2, 31) * _P1, 27) * _P1 + _P4
    at = length - length % 8
    if length % 8 >= 4:
        x, at = turned(x ^ (lanes[starts + at] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3, at + 4
    rest = lanes[starts + at] if at < length else None
    for k in range(length - at):
        x = turned(x ^ ((rest >> np.uint64(8 * k)) & np.uint64(255)) * _P5, 11) * _P1
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def hashed(text: str) -> np.ndarray:
    """Hash of each word of a text."""
    return hash_words([text])[0]


def _slide(values: np.ndarray, span: int, least) -> np.ndarray:
    """Minimum or maximum of every ``span`` values in a row."""
    size = 1
    while 2 * size <= span:
        values, size = least(values[:-size], values[size:]), 2 * size
    return least(values[: len(values) - (span - size)], values[span - size :])


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row: a polynomial of their hashes, put together from runs of 1, 2, 4, ... words."""
    whole, done, part, width, factor = None, 0, hashes, 1, _STEP
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                whole = part if whole is None else whole[: len(part) - done] * factor + part[done:] if len(part) > done else part[:0]
                done += width
            if done == size:
                break
            part = part[:-width] * factor + part[width:] if len(part) > width else part[:0]
            width, factor = 2 * width, factor * factor
        x = (whole ^ (whole >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def fingerprints(grams: np.ndarray, run_words: int, sure_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the window minima among a text's grams; of equal hashes the rightmost. A text that is
    shorter than a window is one window."""
    many = len(grams)
    if many < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    span = min(many, sure_words - run_words + 1)
    none = np.zeros(span - 1, np.uint64)
    lows = _slide(grams, span, np.minimum)
    # a gram is the least of a window if it is the largest minimum of the windows that it lies in
    keep = np.flatnonzero(_slide(np.concatenate([none, lows, none]), span, np.maximum) == grams)
    if (np.diff(keep)[grams[keep[1:]] == grams[keep[:-1]]] < span).any():
        last = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1].argmin(axis=1)
        keep = np.unique(np.arange(len(lows)) + span - 1 - last)
    return keep, grams[keep]


def all_fingerprints(words: list[np.ndarray], run_words: int, sure_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``fingerprints`` of each text, given the hashes of its words: of all texts in a row at once, leaving out windows across a
    border; one by one for texts that are shorter than a window or repeat a fingerprint within one."""
    every, span = grams(np.concatenate(words), run_words), sure_words - run_words + 1
    lengths = np.array([len(w) for w in words])
    begins, many = np.cumsum(lengths) - lengths, np.maximum(lengths - run_words + 1, 0)
    alone, long = (many > 0) & (many < span), many >= span
    keep = np.empty(0, np.int64)
    if long.any():
        border = np.zeros(len(every) - span + 2, np.int8)
        border[begins[long]] = 1
        border[begins[long] + many[long] - span + 1] = -1
        lows = np.where(np.cumsum(border[:-1], dtype=np.int8) > 0, _slide(every, span, np.minimum), np.uint64(0))
        none = np.zeros(span - 1, np.uint64)
        best = _slide(np.concatenate([none, lows, none]), span, np.maximum)
        keep = np.flatnonzero((best == every) & (best > 0))
        again = np.flatnonzero((np.diff(keep) < span) & (every[keep[1:]] == every[keep[:-1]])) + 1
        alone[np.searchsorted(begins, keep[again], "right") - 1] = True
    found, borders = [], [*np.searchsorted(keep, begins).tolist(), len(keep)]
    for k, (begin, n, one_by_one) in enumerate(zip(begins.tolist(), many.tolist(), alone.tolist())):
        at = keep[borders[k] : borders[k + 1]]
        found.append(fingerprints(every[begin : begin + n], run_words, sure_words) if one_by_one else (at - begin, every[at]))
    return found


def repeated_runs(offsets: list[int], theirs: np.ndarray, own: np.ndarray, run_words: int, sure_words: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Begins and ends of the runs of a text that are equal to those of a source, word k of the text standing opposite word
    k - offset of the source for one of the offsets, and have ``run_words`` words or more. Then begins and hashes of the
    windows that share ``run_words`` words or more with such a run and reach beyond it."""
    starts, stops = _equal_runs(offsets, theirs, own, run_words)
    gone = _covered(starts, stops, len(own))
    before, after = np.maximum(starts + run_words - sure_words, 0), np.maximum(starts, stops - sure_words + 1)
    at = np.flatnonzero(_covered(np.concatenate([before, after]), np.concatenate([starts, stops - run_words + 1]), max(0, len(own) - sure_words + 1)))
    if len(at):
        so_far = np.concatenate([[0], np.cumsum(gone)])
        at = at[so_far[at + sure_words] - so_far[at] < sure_words]
    hashes = grams(own[at[0] : at[-1] + sure_words].astype(np.uint64), sure_words).view(np.int64)[at - at[0]] if len(at) else at
    border = _borders(gone)
    return border[::2].tolist(), border[1::2].tolist(), at.tolist(), hashes.tolist()


def _equal_runs(offsets: list[int], theirs: np.ndarray, own: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all runs of ``run_words`` equal words or more, a row of words for each offset, so many rows at once
    as have ``PLACES`` words, or one."""
    width, found = len(own) + 1, []  # a place more in a row, so that no run goes on in the next one
    block, offsets, gone = max(1, PLACES // width), sorted(offsets), np.zeros(len(own), bool)
    for k in range(0, len(offsets), block):
        # after the first rows, an offset that could reach only what is gone is left out
        part = [x for x in offsets[k : k + block] if k == 0 or not gone[max(0, x) : len(theirs) + x].all()]
        same = np.zeros((len(part), width), bool)
        for row, offset in zip(same, part):
            low, high = max(0, offset), min(len(own), len(theirs) + offset)
            np.equal(own[low:high], theirs[low - offset : high - offset], out=row[low:high])
        border = _borders(same.ravel()).reshape(-1, 2)
        found.append(border[border[:, 1] - border[:, 0] >= run_words] % width)
        if k + block < len(offsets) and len(found[-1]):
            gone |= _covered(*found[-1].T, len(own))
    starts, stops = np.concatenate(found).T
    return starts, stops


def _covered(starts: np.ndarray, stops: np.ndarray, many: int) -> np.ndarray:
    """Which of ``many`` places lie in one of the intervals [start, stop), which may reach beyond."""
    starts = np.minimum(starts, many)
    stops = np.maximum(starts, np.minimum(stops, many))
    return np.cumsum(np.bincount(starts, minlength=many + 1) - np.bincount(stops, minlength=many + 1))[:many] > 0


def _borders(same: np.ndarray) -> np.ndarray:
    """Where the runs of true values begin and end, in turn."""
    padded = np.zeros(len(same) + 2, bool)
    padded[1:-1] = same
    return np.flatnonzero(padded[1:] != padded[:-1])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(F.col(id_col), F.col(text_col))})


def find_repeats(df: DataFrame, run_words: int = 25, sure_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key long, runs array<struct<starts int, stops int>>): of each text with later repeated runs, the words
    [starts, stops) to delete. _key is xxhash64(id, text)."""
    texts = _keyed(df, id_col, text_col).where(F.col(text_col).isNotNull()).select("_id", "_key", F.col(text_col).alias("text"))

    def cut(cols: list[list]) -> list[list]:
        found = all_fingerprints(hash_words(cols[2]), run_words, sure_words)
        return [cols[0], cols[1], [at for at, _ in found], [m.view(np.int64) for _, m in found]]

    # repeated rows (same id and text) are one text
    cut_up = map_slices(texts, cut, "_id long, _key long, at array<int>, marks array<long>")
    lined = written(cut_up.where(F.size("marks") > 0), "lines")
    marks = lined.select("_id", "_key", F.explode(F.arrays_zip("at", "marks")).alias("m")).select("_id", "_key", F.col("m.at").alias("at"), F.col("m.marks").alias("mark"))
    place = F.struct(F.coalesce("_id", F.lit(2**63 - 1)).alias("id"), F.col("_key").alias("key"), F.col("at").alias("at"))
    first = written(marks.groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "first"), "first")
    # a gram that a third of all texts have meets one narrow row here
    meets = marks.join(first, "mark").where(F.col("first") != place)
    meets = meets.select(place["id"].alias("_id"), F.col("_key").alias("later"), F.col("first.key").alias("source"), (F.col("at") - F.col("first.at")).alias("offset"))
    # two texts meet once, with all offsets between them (at most the words of the later text)
    meets = written(meets.groupBy("_id", "later", "source").agg(F.collect_set("offset").alias("offsets")), "meets")
    # only texts that meet are needed again, as the lower halves of their hashes: the fingerprints have agreed in full
    keys = if_small(meets.select(F.explode(F.array("later", "source")).alias("k")).distinct(), "keys")
    again = texts.join(keys, F.col("_key") == F.col("k"), "left_semi").select("_key", "text")
    words = map_slices(again, lambda cols: [cols[0], [h.astype(np.uint32).tobytes() for h in hash_words(cols[1])]], "_key long, words binary")
    # rows with the same _key have the same text, so any of them will do; all joins read one shuffle of this
    each = words.groupBy("_key").agg(F.first("words").alias("words"))
    pairs = _with_sources(meets, each).join(each.alias("own"), F.col("later") == F.col("own._key")).select("_id", "later", "offsets", "their_words", "own.words")

    def extend(cols: list[list]) -> list[list]:
        found = [repeated_runs(offsets, np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), run_words, sure_words) for offsets, a, b in zip(*cols[2:])]
        return [cols[0], cols[1], *map(list, zip(*found))]

    runs = written(map_slices(pairs, extend, "_id long, _key long, starts array<int>, stops array<int>, at array<int>, windows array<long>", rows=64), "runs")
    gone = runs.where(F.size("starts") > 0).select("_key", F.explode(F.arrays_zip("starts", "stops")).alias("r")).select("_key", "r.starts", "r.stops")
    wide = runs.where(F.size("at") > 0).select("_id", "_key", F.explode(F.arrays_zip("at", "windows")).alias("w")).select("w.windows", F.struct("_id", "_key", F.col("w.at").alias("at")).alias("place"))
    once = wide.groupBy("windows").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    wide = wide.join(once, "windows").where("place <> first").select("place._key", F.col("place.at").alias("starts"), (F.col("place.at") + sure_words).alias("stops"))
    every = gone.unionByName(wide).distinct()
    return every.groupBy("_key").agg(F.collect_list(F.struct("starts", "stops")).alias("runs"))  # at most its words for each text


def _with_sources(meets: DataFrame, each: DataFrame) -> DataFrame:
    """Adds their_words, those of the source. A source that very many texts repeat is copied to as many tasks as they need."""
    hot = written(meets.groupBy("source").count().where(F.col("count") > HOT).select(F.col("source").alias("hot"), F.ceil(F.col("count") / HOT).alias("parts")), "hot")
    theirs = each.alias("theirs")
    cols = ["_id", "later", "offsets", F.col("theirs.words").alias("their_words")]
    cold = meets.join(theirs, F.col("source") == F.col("theirs._key"))
    if hot.isEmpty():
        return cold.select(cols)
    hot = F.broadcast(hot)  # a row stands for ten thousand meetings
    cold = meets.join(hot, F.col("source") == F.col("hot"), "left_anti").join(theirs, F.col("source") == F.col("theirs._key")).select(cols)
    copies = each.join(hot, F.col("_key") == F.col("hot")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("hot", "part", "words").alias("theirs")
    many = meets.join(hot, F.col("source") == F.col("hot")).withColumn("part", F.pmod(F.xxhash64("later"), "parts")).drop("hot", "parts").alias("m")
    many = many.join(copies, (F.col("m.source") == F.col("theirs.hot")) & (F.col("m.part") == F.col("theirs.part")))
    return cold.unionByName(many.select(cols))


def dedup_lines(df: DataFrame, run_words: int = 25, sure_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with ``text`` less the later repeated runs, and a column line_stats more, struct<n_removed
    int, words_removed int>: the lines (up to a break or the end of a clause) that went whole, and the words that went.

    A run of ``sure_words`` words or more that stands in several texts stays whole in one of them only; one of ``run_words``
    or more may be found. It stays where the id is smallest (a null id
    comes last; then by a hash of the text, then by position) and goes elsewhere, also when it repeats within one
    text. Rows equal in id and text are one text and get the same result. An exact copy of an earlier text
    becomes empty. Shorter repeated runs stay. A null text stays null with null line_stats, an empty one empty.
    ``df`` may have any further columns; one named line_stats is replaced."""
    runs = find_repeats(df, run_words, sure_words, id_col, text_col)
    df = df.drop("line_stats")
    names = df.columns
    joined = _keyed(df, id_col, text_col).join(runs.withColumnsRenamed({"_key": "_run_key", "runs": "_runs"}), F.col("_key") == F.col("_run_key"), "left")
    rows = joined.select(*names, F.transform("_runs", lambda r: r["starts"]).alias("_starts"), F.transform("_runs", lambda r: r["stops"]).alias("_stops"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _cleaned(part, at)

    return rows.mapInArrow(run, f"{schema}, line_stats struct<n_removed: int, words_removed: int>")


def without_runs(text: str, starts: list[int], stops: list[int]) -> tuple[str, int, int]:
    """A text less the words [start, stop) of each run; the lines that went whole, the words that went."""
    borders, ends = _parts(text)
    gone = np.zeros(len(ends), bool)
    for a, b in zip(starts, stops):
        gone[a:b] = True
    begins = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    whole = np.logical_and.reduceat(gone, begins)
    rest = borders[_borders(~gone)].tolist()
    kept = "".join(text[a:b] for a, b in zip(rest[::2], rest[1::2]))
    return "" if kept.isspace() else kept.rstrip(), int(whole.sum()), int(gone.sum())


def _cleaned(part: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """Rows whose last two columns are begins and ends of their runs: column ``at`` without them, and line_stats. Rows
    without runs stay as they are."""
    texts, starts, stops = part.column(at), part.column(part.num_columns - 2), part.column(part.num_columns - 1)
    hit = np.flatnonzero(texts.is_valid().to_numpy(False) & starts.is_valid().to_numpy(False))
    n_lines, n_words, columns = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), part.columns[:-2]
    if len(hit):
        new = [without_runs(*row) for row in zip(*(c.take(pa.array(hit)).to_pylist() for c in (texts, starts, stops)))]
        n_lines[hit], n_words[hit] = [n for _, n, _ in new], [n for _, _, n in new]
        mask = np.zeros(len(texts), bool)
        mask[hit] = True
        columns[at] = pc.replace_with_mask(texts, pa.array(mask), pa.array([t for t, _, _ in new], texts.type))
    stats = pa.StructArray.from_arrays([pa.array(n_lines), pa.array(n_words)], names=["n_removed", "words_removed"], mask=texts.is_null())
    return pa.RecordBatch.from_arrays([*columns, stats], names=[*part.schema.names[:-2], "line_stats"])


def drop_emptied(df: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The rows of ``df`` with the text that ``dedup_lines`` leaves; those of which it leaves nothing go."""
    out = dedup_lines(df, text_col=text_col, **more)
    return out.where(~((F.col("line_stats.words_removed") > 0) & (F.col(text_col) == "")) | F.col(text_col).isNull()).drop("line_stats")
