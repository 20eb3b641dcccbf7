"""Quality classifier: an interpolated modified Kneser-Ney n-gram model (operator 8).

The model's units are the bytes of the texts, its order is 5, so every letter of every script is its own sequence, and
an n-gram is a number of which prefix and suffix are bit operations. The n-grams of the trusted texts are counted, all of
them, and the tables grow with those texts. Each order's continuation counts, totals and numbers of
successors come from joins and groupings of the order above, sharded by Spark.

Texts are scored by a join with these counts. Each task forms slices of some ``SLICE_BYTES`` of text and sends the distinct n-grams
of a slice, not one row for each place; their probabilities come from joins with the tables of orders 5 to 0 and go back
to the slice, where they are summed up for each text. Tables beyond a checked size are joined by shuffles.

A text's perplexity is compared with quantiles of the trusted texts of its language, by bands of length, because
short texts vary more. A part of the trusted texts is held out of the training and says how much may surprise the
model; those that it was trained on say how regular a good text may be. Both tails are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingscope.llm import memos
from ratingscope.llm.common import if_small, slices, without_ids, written

#: Bytes in an n-gram; the byte that stands before a text, which no UTF-8 text has.
ORDER, BEGIN = 5, 255
#: Bytes of text in a slice: the more, the fewer n-grams are sent for each text; a task holds one slice at a time.
SLICE_BYTES = 1 << 25
#: One trusted text in so many is held out of the training.
HELD_OUT = 5
#: Most trusted ids that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each byte of the texts, as numbers, and the bytes of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    pad = ORDER - 1
    filled = np.frombuffer((bytes([BEGIN]) * pad).join([b"", *data]), np.uint8).astype(np.int64)
    grams = np.zeros(max(0, len(filled) - pad), np.int64)
    for back in range(pad, -1, -1):
        grams = grams << 8 | filled[pad - back : len(filled) - back]
    inside = np.ones(len(grams), bool)  # n-grams that end in the bytes before a text go
    for k in range(pad):
        inside[(np.cumsum(sizes + pad) - pad)[:-1] + k] = False
    return grams[inside], sizes


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table (n-gram, how often) from several."""
    if len(found) == 1:
        return found[0]
    kinds, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate([n for _, n in found]), len(kinds)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task in slices, each a list of parts of a megabyte."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(part)
            size += part.nbytes
            if size >= SLICE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counted(held: list[pa.RecordBatch], column: int) -> tuple[np.ndarray, np.ndarray]:
    tables = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for part in held:
        tables.append(np.unique(ngrams([t or "" for t in part.column(column).to_pylist()])[0], return_counts=True))
        if sum(len(g) for g, _ in tables[1:]) > len(tables[0][0]) + 500_000:
            tables = [_merged(tables)]
    return _merged(tables)


def count_ngrams(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram long, n long): how often each n-gram ends at a byte of the texts."""

    def run(batches):
        with memos.for_task(__name__):
            for held in _slices(batches):
                grams, n = _counted(held, 0)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return texts.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * k) - 1))


def train(counts: DataFrame) -> list[DataFrame]:
    """For k = 0 .. ORDER, (gram long, p double, gamma double): the probability of an n-gram of k bytes given all but
    its last byte, null if it never occurred, and the weight of the shorter context where the n-gram is a context, null if it is none.

    Discounts D1, D2, D3+ of each order come from its counts of counts; a lower order counts the distinct bytes
    before an n-gram. The order 0 has one row, with p 1/256."""
    spark = counts.sparkSession
    tables = {ORDER: written(counts, "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    out = []
    p = spark.range(1).select(F.lit(0).cast("long").alias("gram"), F.lit(1 / 256).alias("p"))
    for k in range(1, ORDER + 1):
        c = tables[k].withColumn("context", F.shiftright("gram", 8))
        n1, n2, n3, n4 = c.agg(*(F.count_if(F.col("n") == j) for j in (1, 2, 3, 4))).first()
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        less = [j - (j + 1) * y * b / a if a and b else 0.5 * j for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        less = [min(max(d, 0.05), j - 0.05) for j, d in enumerate(less, 1)]
        cut = F.when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2])
        contexts = written(c.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("gamma")), "contexts")
        shorter = p.unionByName(contexts.select(F.col("context").alias("gram"), "gamma"), allowMissingColumns=True)
        out.append(if_small(shorter.groupBy("gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")), "model"))
        lower = out[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        of = out[-1].select(F.col("gram").alias("context"), F.col("gamma"))
        seen = c.join(contexts.select("context", "total"), "context").join(of, "context").withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(lower, "suffix")
        p = seen.select("gram", ((F.col("n") - cut) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p"))
    return [*out, written(p.withColumn("gamma", F.lit(None).cast("double")), "model")]


def _scored(grams: DataFrame, model: list[DataFrame]) -> DataFrame:
    """Adds nll to a table with a column gram: -ln of the probability of its last byte."""
    value = F.lit(1 / 256)
    for k, table in enumerate(model):
        names = {"gram": f"_g{k}", "p": f"_p{k}", "gamma": f"_w{k}"}
        of = table.withColumnsRenamed(names)
        if k:
            grams = grams.join(of.select(f"_g{k}", f"_p{k}"), _suffix(F.col("gram"), k) == F.col(f"_g{k}"), "left").drop(f"_g{k}")
            value = F.coalesce(f"_p{k}", F.coalesce(f"_w{k - 1}", F.lit(1.0)) * value)
        if k < ORDER:  # the context of the next order's n-gram
            context = F.shiftright(_suffix(F.col("gram"), k + 1), 8)
            grams = grams.join(of.select(f"_g{k}", f"_w{k}"), context == F.col(f"_g{k}"), "left").drop(f"_g{k}")
    return grams.select("gram", (-F.log(value)).alias("nll"))


def perplexities(df: DataFrame, model: list[DataFrame], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, bytes long, nll double): negative log-likelihood of each text, in nats; 0 of 0 bytes for null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    texts = df.select(id_col, lang_col, text_col)
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in (("id", id_col), ("lang", lang_col))) + ", bytes long, nll double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def key(held: list[pa.RecordBatch]) -> int:
        """A slice goes by a hash of what is in it, so that it has the same name however often a task is run."""
        h = xxhash.xxh64()
        for part in held:
            for c in part.columns:
                h.update(repr(c.to_pylist()).encode("utf-8", "surrogatepass"))
        return h.intdigest() - (1 << 63)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memos.for_task(__name__):
            for held in _slices(batches):
                yield pa.RecordBatch.from_arrays([pa.array([key(held)]), pa.array([_counted(held, 2)[0]], pa.list_(pa.int64()))], names=["slice", "grams"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memos.for_task(__name__):
            for held in _slices(batches):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    for part in held:
                        out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([key(held)]), pa.array([sink.getvalue().to_pybytes()])], names=["slice", "texts"])

    def add_up(texts: pa.Table, grams: pa.Table) -> pa.Table:
        kinds, nll = (grams.column(n).to_numpy() for n in ("gram", "nll"))
        order = np.argsort(kinds)
        kinds, nll, out = kinds[order], nll[order], []
        for packed in texts.column("texts").to_pylist():
            for part in pa.ipc.open_stream(packed):
                found, sizes = ngrams([t or "" for t in part.column(2).to_pylist()])
                at = np.searchsorted(kinds, found)
                if len(found) and (at.max() == len(kinds) or (kinds[at] != found).any()):
                    raise RuntimeError("a slice has n-grams that were not scored")
                sums = np.concatenate([[0.0], np.cumsum(nll[at])])
                stops = np.cumsum(sizes)
                out.append(pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), part.column(1).cast(arrow[1].type), pa.array(sizes), pa.array(sums[stops] - sums[stops - sizes])], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    sent = texts.mapInArrow(send, "slice long, grams array<long>").select("slice", F.explode("grams").alias("gram"))
    sent = written(sent, "sent")
    back = sent.join(_scored(sent.select("gram").distinct(), model), "gram")
    packed = texts.mapInArrow(pack, "slice long, texts binary")
    return packed.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(add_up, schema)


def score(df: DataFrame, trusted: DataFrame, quantile: float = 0.01, fence: float = 0.5, least: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_bytes long, perplexity double, low double, high double, keep boolean) of every row.

    ``trusted`` (column ``id_col``) names the texts that train the model and set the thresholds: the quantile
    ``quantile`` of the mean log-likelihood of those that it was trained on, and 1 - ``quantile`` of those held out (one in
    ``HELD_OUT``, by a hash of the id), per language and power of two of the length, moved outwards by ``fence`` times their
    distance. A band with fewer than ``least`` held-out or trained texts takes the thresholds of the whole language, a language with fewer
    those of all languages together (for which a ``HELD_OUT``th of ``least`` held-out texts will do); a language without any, or if these are
    fewer too, keeps all. Null and empty texts have no perplexity and are rejected. A null
    language is a language; a null id is trusted by nobody. Repeated rows are scored alike, and count as often as they occur. Only the named
    columns are read."""
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_held", F.pmod(F.xxhash64("_id"), F.lit(HELD_OUT)) == 0)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = df.join(ids.where("not _held"), df[id_col] == F.col("_id"), "left_semi")
    model = train(count_ngrams(texts.select(F.col(text_col).alias("text"))))
    scored = written(perplexities(df, model, id_col, text_col, lang_col), "scored")
    scored = scored.withColumns({"mean": F.try_divide("nll", "bytes"), "band": F.floor(F.log2(F.col("bytes") + 1)).cast("int")})
    sample = scored.where("bytes > 0").join(ids, F.col("id") == F.col("_id"))

    def ends(*by: str, name: str, held: int = least) -> DataFrame:
        """(by, name): the ends of groups with enough texts of both kinds."""
        low = F.percentile_approx(F.when(~F.col("_held"), F.col("mean")), quantile, 10_000)
        high = F.percentile_approx(F.when(F.col("_held"), F.col("mean")), 1 - quantile, 10_000)
        enough = (F.count_if("_held") >= held) & (F.count_if(~F.col("_held")) >= least)
        found = sample.groupBy(*by).agg(F.struct(low.alias("low"), high.alias("high")).alias(name), enough.alias("_enough"))
        return found.where("_enough").select(*(F.col(c).alias(f"_{c}") for c in by), name)

    same = F.col("lang").eqNullSafe(F.col("_lang"))
    out = scored.join(F.broadcast(ends("lang", "band", name="q1")), same & (F.col("band") == F.col("_band")), "left").drop("_lang", "_band")
    out = out.join(F.broadcast(ends("lang", name="q2")), same, "left").drop("_lang")
    rare = sample.select(F.col("lang").alias("_lang")).distinct().join(F.broadcast(ends(name="q3", held=max(1, least // HELD_OUT))), F.lit(True))  # a row a language
    out = out.join(F.broadcast(rare), same, "left").drop("_lang")
    q = F.coalesce("q1", "q2", "q3")
    room = fence * F.greatest(q["high"] - q["low"], F.lit(0.0))
    low, high = q["low"] - room, q["high"] + room
    out = out.withColumns({"low": F.exp(low), "high": F.exp(high), "perplexity": F.exp("mean")})
    keep = (F.col("bytes") > 0) & F.coalesce(F.col("mean").between(low, high), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("bytes").alias("n_bytes"), "perplexity", "low", "high", keep.alias("keep"))


def keep_good(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of ``df`` that ``score`` keeps, with their columns as they are. If an id has several rows and one is
    rejected, all go; a row without an id goes only if its text is null or empty."""
    scored = score(df, trusted, id_col=id_col, **more)
    text = F.col(more.get("text_col", "text"))
    return without_ids(df.where(F.length(text) > 0), scored.where("not keep").select(id_col), id_col)
