"""Keyword and vector retrieval, their fusion, and the index tables behind them.

Everything is batched: queries carry a query_id, and one plan answers all of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, tokens
from ..runtime import bounded_broadcast, drop_path, new_path, short_batches, spread, written

K1, B, EPSILON = 1.5, 0.75, 0.25
_WORD_LETTERS = np.array([c for c in range(128) if chr(c).isalnum()])
INDEX_VERSION = 4
#: Row groups of 8 MB about, that a reader, which takes one at a time, holds few of the long rows of ``forward``.
_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16"}
#: A term that more than one in so many documents of a lot have is common; at most so many get a column.
COMMON, COLUMNS = 32, 128


def corpus_text(recipes: DataFrame, bridge: DataFrame, dictionary: DataFrame, recipe_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, text): title, description, names and aliases of the ingredients, and tags of each recipe.

    Ingredients come in order of their id and tags in order of theirs; what refers to no entry is left out.
    """
    terms = F.concat(F.array("name"), F.filter(F.coalesce("aliases", F.array()), lambda a: a.isNotNull() & (a != "")))
    named = bounded_broadcast(dictionary.select(F.col("id").alias("ingredient_id"), F.array_join(terms, " ").alias("words")), 10_000)
    # by recipe before anything else, so that what follows needs no further shuffle
    used = bridge.select("recipe_id", "ingredient_id").repartition("recipe_id").distinct().join(named, "ingredient_id")
    used = used.groupBy("recipe_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ingredient_id", "words"))), lambda x: x["words"]), " ").alias("w"))
    labels = bounded_broadcast(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), 10_000)
    tagged = recipe_tags.select("recipe_id", "tag_id").repartition("recipe_id").distinct().join(labels, "tag_id")
    tagged = tagged.groupBy("recipe_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tag_id", "tag"))), lambda x: x["tag"]), " ").alias("t"))
    full = recipes.select(F.col("id").alias("recipe_id"), "title", "description").join(used, "recipe_id", "left").join(tagged, "recipe_id", "left")
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("title", "description", "w", "t")]
    return full.select(F.col("recipe_id").alias("doc_id"), clean_text(F.concat_ws(" ", *parts)).alias("text"))


@dataclass(frozen=True)
class TextIndex:
    """forward (docs, dls, sizes, known, terms, tfs), term_stats (term, df, idf), totals (n, avgdl) of one row.

    A row of ``forward`` is a lot of documents, so that a term is written once for the lot: ``docs`` and ``dls`` are their
    ids and lengths, ``sizes`` how many terms each has, ``terms`` the places of these in ``known``, and ``tfs`` how often
    each occurs.
    """

    forward: DataFrame
    term_stats: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, dl, tf)"""
        kind = self.forward.schema["docs"].dataType.elementType.simpleString()
        return self.forward.mapInArrow(_posting_rows, f"term string, doc_id {kind}, dl int, tf int")


def count_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(dl, offsets, terms, tfs) of ``texts``: their :func:`tokens`, counted over a whole lot of texts at once."""
    joined = "\n".join([t or "" for t in texts])
    cp = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])[: len(cp)]

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    han = (cp >= 0x4E00) & (cp <= 0x9FFF)
    pair = np.flatnonzero(han[:-1] & han[1:])
    first, last = runs(han)
    single = first[last - first == 1]
    first, last = runs((cp < 128) & np.isin(cp, _WORD_LETTERS))
    words = pa.array([joined[x:y].lower() for x, y in zip(first.tolist(), last.tolist())], pa.string()).dictionary_encode()
    # a pair by both letters, a single one by its own, and words beyond these
    code = np.concatenate([cp[pair] << 16 | cp[pair + 1], cp[single] << 16, (1 << 32) + words.indices.to_numpy().astype(np.int64)])
    doc = doc[np.concatenate([pair, single, first])]
    known, code = np.unique(code, return_inverse=True)
    cell, tfs = np.unique(doc * len(known) + code, return_counts=True)
    own, held = known[known < 1 << 32], words.dictionary.to_pylist()
    names = [chr(c >> 16) + (chr(c & 0xFFFF) if c & 0xFFFF else "") for c in own.tolist()] + [held[c - (1 << 32)] for c in known[len(own) :].tolist()]
    off = np.searchsorted(cell, np.arange(len(texts) + 1) * len(known)).astype(np.int32)
    terms = pa.DictionaryArray.from_arrays(pa.array(cell % max(1, len(known)), pa.int32()), pa.array(names, pa.string()))
    return np.bincount(doc, minlength=len(texts)), off, terms, tfs


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> a row of ``forward`` for each 4,000."""
    for whole in batches:
        for b in (whole.slice(at, 4_000) for at in range(0, len(whole), 4_000)):
            dl, off, terms, tfs = count_terms(b.column("text").to_pylist())
            cols = [b.column("doc_id"), pa.array(dl, pa.int32()), pa.array(np.diff(off), pa.int32()), terms.dictionary, terms.indices, pa.array(tfs, pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in cols], ["docs", "dls", "sizes", "known", "terms", "tfs"])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, terms) -> (term, df), each term once for a lot."""
    for b in batches:
        for known, terms in zip(b.column("known"), b.column("terms")):
            df = np.bincount(terms.values.to_numpy(), minlength=len(known.values))
            yield pa.RecordBatch.from_arrays([known.values, pa.array(df, pa.int64())], ["term", "df"])


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in range(len(b)):
            docs, dls, sizes, known, terms, tfs = (b.column(c)[x].values for c in ("docs", "dls", "sizes", "known", "terms", "tfs"))
            at = pa.array(np.repeat(np.arange(len(docs)), sizes.to_numpy()))
            yield pa.RecordBatch.from_arrays([known.take(terms), docs.take(at), dls.take(at), tfs], ["term", "doc_id", "dl", "tf"])


def _statistics(forward: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term_stats, totals); a negative idf becomes a quarter of the mean idf of all terms."""
    totals = forward.select(F.explode("dls").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = forward.select("known", "terms").mapInArrow(_term_rows, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(totals.select("n")))
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), totals


def build_index(docs: DataFrame, path: str | None = None) -> TextIndex:
    """Okapi statistics of (doc_id, text), below ``path`` if given. Texts are tokenised once; only counts of terms are shuffled.

    Null texts are documents without tokens.
    """
    kind, spark = dict(docs.dtypes)["doc_id"], docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        place = f"{path}/{name}" if path else new_path(spark, name)
        df.write.mode("overwrite").option("compression", "zstd").options(**_GROUPS).parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    # written first, since to count the partitions of what is derived runs all that it is derived from
    texts = new_path(spark, "texts")
    docs.select("doc_id", "text").write.option("compression", "zstd").parquet(texts)
    read = spread(spark.read.schema(docs.select("doc_id", "text").schema).parquet(texts))
    forward = kept(read.mapInArrow(_counted_terms, f"docs array<{kind}>, dls array<int>, sizes array<int>, known array<string>, terms array<int>, tfs array<int>"), "forward")
    drop_path(spark, texts)
    stats, totals = _statistics(forward)
    with short_batches(spark):
        return TextIndex(forward, kept(stats, "term_stats"), kept(totals, "totals"))


_TABLES = ("forward", "term_stats", "totals")


def save_index(index: TextIndex, path: str, fingerprint: str) -> None:
    """Write the tables and, last, the manifest that makes them count."""
    for name in _TABLES:
        getattr(index, name).write.mode("overwrite").options(**_GROUPS).parquet(f"{path}/{name}")
    _mark_index(index.totals.sparkSession, path, fingerprint)


def _mark_index(spark: SparkSession, path: str, fingerprint: str) -> None:
    row = json.dumps({"version": INDEX_VERSION, "fingerprint": fingerprint})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, fingerprint: str | None = None) -> TextIndex | None:
    """The stored index; None if there is none, or it is of another version or of other inputs."""
    try:
        row = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except (AnalysisException, TypeError, ValueError):
        return None
    if row.get("version") != INDEX_VERSION or fingerprint not in (None, row.get("fingerprint")):
        return None
    return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in _TABLES))


def inputs_fingerprint(*tables: DataFrame) -> str:
    """A number of rows and a sum of row hashes for each input table, so that a change in any of them shows."""
    out = []
    for t in tables:
        r = t.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(c) for c in t.columns]).cast("decimal(38,0)"))).first()
        out.append(f"{r[0]}:{r[1]}")
    return "|".join(out)


def refreshed_index(path: str, inputs: tuple[DataFrame, ...], docs: Callable[[], DataFrame]) -> TextIndex:
    """The index stored at ``path`` if its inputs are unchanged, else a new one of ``docs()``, which takes its place.

    A version lies in a folder named by the fingerprint of its inputs, so readers of the last one are not disturbed.
    """
    spark, mark = inputs[0].sparkSession, inputs_fingerprint(*inputs)
    place = f"{path}/{hashlib.md5(mark.encode()).hexdigest()}"
    found = load_index(spark, place, mark)
    if found is None:
        build_index(docs(), place)
        _mark_index(spark, place, mark)
        found = load_index(spark, place, mark)
    assert found is not None
    return found


class _Best:
    """The best ``k`` of each query over all batches of a task: highest key first, then the lesser id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.key, self.ident = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)
        self.rest: dict[str, np.ndarray] = {}
        self.edge = np.full(queries, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray, **rest: np.ndarray) -> None:
        key = np.floor(score * 1e9 + 0.5).astype(np.int64)
        ok = key >= self.edge[query]
        got = {"score": score[ok], **{n: v[ok] for n, v in rest.items()}}
        query, key, ident = query[ok], key[ok], ident[ok]
        if not len(query):
            return
        if len(self.query):
            query, key, ident = np.concatenate([self.query, query]), np.concatenate([self.key, key]), np.concatenate([self.ident, ident])
            got = {n: np.concatenate([self.rest[n], v]) for n, v in got.items()}
        order = np.lexsort((ident, -key, query))
        at = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
        order = order[at < self.k]
        self.query, self.key, self.ident = query[order], key[order], ident[order]
        self.rest = {n: v[order] for n, v in got.items()}
        last = np.flatnonzero(at[at < self.k] == self.k - 1)
        self.edge[self.query[last]] = self.key[last]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of each row of ``forward``; documents that stand by themselves (doc_id, dl, terms, tfs) are put together."""
    for whole in batches:
        if "known" in whole.schema.names:
            for x in range(len(whole)):
                yield tuple(whole.column(c)[x].values for c in ("docs", "dls", "sizes", "known", "terms", "tfs"))
            continue
        for b in (whole.slice(x, 4_000) for x in range(0, len(whole), 4_000)):
            terms = b.column("terms").flatten().dictionary_encode()
            yield b.column("doc_id"), b.column("dl"), b.column("terms").value_lengths(), terms.dictionary, terms.indices, b.column("tfs").flatten()


def _lots(batches: Iterator[pa.RecordBatch], known: pa.Array, avgdl: float, most: int = 65_536, most_parts: int = 4_000_000) -> Iterator[tuple[np.ndarray, tuple]]:
    """Lots of about ``most`` documents: their ids, and for the ``known`` terms (starts, documents, parts of the score)."""
    kept: list[tuple] = []
    docs = parts = 0

    def lot() -> tuple[np.ndarray, tuple]:
        ids, at, doc, part = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        order = np.argsort(at, kind="stable")
        return ids, (np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(known)))]).tolist(), doc[order].astype(np.int64), part[order])

    for own, dls, sizes, names, terms, tfs in _pieces(batches):
        place = pa.compute.fill_null(pa.compute.index_in(names, known), -1).to_numpy()
        at = place[terms.to_numpy()]
        hit = np.flatnonzero(at >= 0)
        doc = np.repeat(np.arange(len(own)), sizes.to_numpy())[hit]
        tf, dl = tfs.to_numpy()[hit].astype(float), dls.to_numpy()
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
        # short numbers are sorted by their digits
        kept.append((np.array(own.to_pylist()), at[hit].astype(np.uint16 if len(known) < 1 << 16 else np.int32), (docs + doc).astype(np.int32), part))
        docs, parts = docs + len(own), parts + len(hit)
        if docs >= most or parts >= most_parts:
            yield lot()
            docs = parts = 0
    if kept:
        yield lot()


def _scored(lists: tuple, docs: int, start: list[int], term: list[int], weight: list[float], best: _Best, k: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, score, document): the documents of a lot that can be among the best ``k`` of a query, ``most`` rows and more at a time.

    Terms that many documents have weigh little. What they can add at most says which documents can still come in by the
    other terms, and only for these they are looked up, in a column over all documents.
    """
    first, doc, part = lists
    columns: dict[int, tuple[np.ndarray, float]] = {}
    sizes = np.diff(first)
    for t in np.argsort(-sizes, kind="stable")[:COLUMNS].tolist():
        if sizes[t] > docs // COMMON:
            at = slice(first[t], first[t + 1])
            columns[t] = np.zeros(docs), float(part[at].max())
            columns[t][0][doc[at]] = part[at]
    total, mark, count = np.zeros(docs), np.empty(docs, np.int64), np.arange(len(doc))
    found, rows = [], 0

    def whole(at: np.ndarray, late: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Each of the documents once, and its score with the late terms."""
        mark[at] = count[: len(at)]
        at = at[mark[at] == count[: len(at)]]
        score = total[at]
        for _, t, w in late:
            score += w * columns[t][0][at]
        return at, score

    for q in range(len(start) - 1):
        late, near = [], []
        for t, w in zip(term[start[q] : start[q + 1]], weight[start[q] : start[q + 1]]):
            if t in columns:
                late.append((w * columns[t][1], t, w))
            elif first[t] < first[t + 1]:
                at = doc[first[t] : first[t + 1]]
                total[at] += w * part[first[t] : first[t + 1]]
                near.append(at)
        # by a digit less than the key, of which the best decides
        least = max(0, int(best.edge[q]) - 2) / 1e9
        held = near[0] if len(near) == 1 else np.concatenate(near) if near else doc[:0]
        if late and not least and len(held) > (n := k * len(near)):
            # a document stands there once for each of its terms, so these are k different ones at least
            score = whole(held[np.argpartition(total[held], len(held) - n)[len(held) - n :]], late)[1]
            least = max(0.0, float(np.partition(score, len(score) - k)[len(score) - k]) - 2e-9)
        late.sort()
        more = sum(max(0.0, x[0]) for x in late)
        if more > least:
            # documents with none of the terms so far can come in
            while late and more > least:
                _, t, w = late.pop()
                at = doc[first[t] : first[t + 1]]
                total[at] += w * part[first[t] : first[t + 1]]
                near.append(at)
                more = sum(max(0.0, x[0]) for x in late)
            held = np.concatenate(near)
        at, score = whole(held[total[held] > least - more], late)
        total[held] = 0
        good = score > least
        at, score = at[good], score[good]
        if len(at) > k:
            good = score >= np.partition(score, len(at) - k)[len(at) - k] - 2e-9
            at, score = at[good], score[good]
        if len(at):
            found.append((np.full(len(at), q), score, at))
            rows += len(at)
        if rows >= most:
            yield tuple(np.concatenate(x) for x in zip(*found))
            found, rows = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found))


def _blocks(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The rows of ``queries`` (query_id first) in blocks of about ``most``, a query whole; each is sent to all tasks."""
    count = queries.count()
    blocks = -(-count // most)
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        lot = part.toArrow()
        if len(lot):
            yield lot


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def bm25_best(index: TextIndex, queries: DataFrame, k: int, most_terms: int = 200_000) -> DataFrame:
    """(query_id, doc_id, score): at least the best ``k`` documents of each query, those of each task; scores above 0.

    The weighted terms of the queries go to the tasks in blocks of bounded size. A task turns its documents, lot by lot,
    into lists by term, adds up the lists of each query's terms, and gives its own best ``k`` only, so that what is
    shuffled is queries x k for each task. A token given twice counts twice.
    """
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weights = written(asked.join(index.term_stats, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")), "query-terms")
    kind = index.forward.schema["docs"].dataType.elementType.simpleString()
    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {kind}, score double"
    avgdl = index.totals.first().avgdl or 1.0
    spark, parts = index.forward.sparkSession, []
    forward = spread(index.forward)
    for block in _blocks(weights, most_terms):
        ids, query = np.unique(np.array(block.column("query_id").to_pylist(), object), return_inverse=True)
        terms, term = np.unique(np.array(block.column("term").to_pylist(), object), return_inverse=True)
        order = np.lexsort((term, query))
        sent = spark.sparkContext.broadcast((ids, terms, np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(ids)))]), term[order], block.column("w").to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, terms, start, term, weight = sent.value
            best = _Best(len(ids), k)
            for docs, lists in _lots(batches, pa.array(terms.tolist(), pa.string()), avgdl):
                for query, score, doc in _scored(lists, len(docs), start.tolist(), term.tolist(), weight.tolist(), best, k):
                    best.add(query, score, docs[doc])
            if len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.query].tolist()), pa.array(best.ident.tolist()), pa.array(best.rest["score"])], ["query_id", "doc_id", "score"])

        parts.append(forward.mapInArrow(run, schema))
    return _union(parts) if parts else spark.createDataFrame([], schema)


def top(scored: DataFrame, k: int, score: str = "score", best_first: bool = True, ident: str = "doc_id") -> DataFrame:
    """The ``k`` best of each query with their ``rank`` from 1; scores equal to nine digits go by id."""
    by = F.floor(F.col(score) * 1e9 + 0.5)
    order = Window.partitionBy("query_id").orderBy(by.desc() if best_first else by.asc(), F.col(ident))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """The best documents with a positive score. Queries of the same text are searched as one."""
    texts = queries.groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    named = written(texts.withColumn("first", F.min("query_id").over(Window.partitionBy("texts"))), "asked")
    firsts = named.where("query_id = first").select("query_id", F.explode("texts").alias("text"))
    with short_batches(queries.sparkSession):
        hits = written(top(bm25_best(index, firsts, k), k).withColumnRenamed("query_id", "first"), "found")
    return hits.join(bounded_broadcast(named.select("first", "query_id")), "first").select("query_id", "doc_id", "score", "rank")


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def knn(chunks: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, chunk_id, doc_id, distance, rank): the exact ``k`` nearest chunks (chunk_id, doc_id, vec) of each query.

    The queries go to the tasks as one matrix for each block of bounded size; chunks are read once for each block, and a
    task gives its own best ``k`` only. Null vectors and chunks without an id are left out; vectors of another size than the queries' fail the job.
    """
    kinds = dict(chunks.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, distance double"
    spark, parts = chunks.sparkSession, []
    full = chunks.where("vec is not null and chunk_id is not null").select("chunk_id", "doc_id", "vec")
    for lot in _blocks(queries.where("vec is not null").select("query_id", "vec"), block):
        sent = spark.sparkContext.broadcast((np.array(lot.column("query_id").to_pylist(), object), _unit(np.array(lot.column("vec").to_pylist(), float))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, wanted = sent.value
            best = _Best(len(ids), k)
            for whole in batches:
                for b in (whole.slice(at, 1_000) for at in range(0, len(whole), 1_000)):
                    near = wanted @ _unit(np.array(b.column("vec").to_pylist(), float)).T
                    # what is farther than the k-th so far can't come in
                    q, c = np.nonzero(near - 1 >= best.edge[:, None] / 1e9 - 1e-8)
                    best.add(q, near[q, c] - 1, np.array(b.column("chunk_id").to_pylist())[c], doc=np.array(b.column("doc_id").to_pylist(), object)[c])
            if len(best.query):
                cols = [pa.array(ids[best.query].tolist()), pa.array(best.ident.tolist()), pa.array(best.rest["doc"].tolist()), pa.array(-best.rest["score"])]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "chunk_id", "doc_id", "distance"])

        parts.append(full.mapInArrow(run, schema))
    return top(_union(parts) if parts else spark.createDataFrame([], schema), k, "distance", False, "chunk_id")


def nearest_entry(rows: DataFrame, entries: DataFrame, block: int = 4096) -> DataFrame:
    """(item, id, distance): for each of ``rows`` (item, vec) the nearest of ``entries`` (id, vec), of equal ones the least id.

    The entries go to the tasks as matrices of bounded size, and rows are read once for each. Null vectors match nothing.
    """
    schema = f"item {dict(rows.dtypes)['item']}, id {dict(entries.dtypes)['id']}, distance double"
    spark, parts = rows.sparkSession, []
    full = rows.where("vec is not null").select("item", "vec")
    for lot in _blocks(entries.where("vec is not null").select(F.col("id").alias("query_id"), "vec").orderBy("query_id"), block):
        sent = spark.sparkContext.broadcast((np.array(lot.column("query_id").to_pylist()), _unit(np.array(lot.column("vec").to_pylist(), float))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, known = sent.value
            for b in batches:
                if len(b):
                    key = np.floor((1 - _unit(np.array(b.column("vec").to_pylist(), float)) @ known.T) * 1e9 + 0.5)
                    at = key.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(ids[at].tolist()), pa.array(key[np.arange(len(b)), at] / 1e9)], ["item", "id", "distance"])

        parts.append(full.mapInArrow(run, schema))
    near = _union(parts) if parts else spark.createDataFrame([], schema)
    return near.groupBy("item").agg(F.min(F.struct("distance", "id")).alias("x")).select("item", "x.id", "x.distance")


def within(hits: DataFrame, most: float) -> DataFrame:
    """Hits no farther than ``most`` (an unknown distance counts as 1), ranked anew from 1."""
    near = hits.where(F.coalesce("distance", F.lit(1.0)) <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))


def reciprocal_rank(rank: Column, k: float, weight: float) -> Column:
    """Weighted mean of 1 / (k + rank) over the rows of a group."""
    return F.lit(weight) * F.avg(1.0 / (F.lit(k) + rank))


def roll_up(hits: DataFrame, known: DataFrame, k: float = 60, weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((query_id, doc_id, vector_score), (query_id, degraded)) of ranked chunk hits.

    Chunks whose document is not among ``known`` (doc_id) are orphans: they keep their rank but give nothing; if all
    of a query's hits are orphans the query is degraded. Hits without a document belong to none.
    """
    marked = hits.join(known.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    scores = marked.where("known").groupBy("query_id", "doc_id").agg(reciprocal_rank(F.col("rank"), k, weight).alias("vector_score"))
    state = marked.where("doc_id is not null").groupBy("query_id").agg((F.count_if("known") == 0).alias("degraded"))
    return scores, state


def branch_states(queries: DataFrame, hits: DataFrame, known: DataFrame, vectors_ready: bool) -> DataFrame:
    """(query_id, degraded, reasons): how the vector branch fared for each of ``queries`` (query_id).

    Without a vector table it is degraded for all; where all hits that name a document are orphans it is for that query;
    no hits at all, or hits that name none, are no fault. Reasons are joined by a full-width semicolon.
    """
    state = roll_up(hits, known)[1]
    lost = F.coalesce("degraded", F.lit(False))
    reasons = F.array_compact(F.array(F.when(F.lit(not vectors_ready), F.lit("no vectors")), F.when(lost & F.lit(vectors_ready), F.lit("orphans only"))))
    out = queries.select("query_id").distinct().join(state, "query_id", "left")
    return out.select("query_id", (F.size(reasons) > 0).alias("degraded"), F.array_join(reasons, "；").alias("reasons"))


def fuse(keyword: DataFrame, vector: DataFrame, top_k: int, k: float = 60, weight: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, rank) from keyword ranks (query_id, doc_id, rank) and vector scores; a missing side is 0."""
    if not (k > 0 and 0 <= weight <= 1 and top_k > 0):
        raise ValueError("k and top_k are positive, and a weight is between 0 and 1")
    a = keyword.select("query_id", "doc_id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("keyword_score"))
    both = a.join(vector, ["query_id", "doc_id"], "full_outer")
    total = F.coalesce("keyword_score", F.lit(0.0)) + F.coalesce("vector_score", F.lit(0.0))
    return top(both.select("query_id", "doc_id", total.alias("score")), top_k)


def upsert_vectors(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """``new`` (chunk_id, doc_id, vec) over ``old``; a vector of another size fails the job."""
    checked = new.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} values"))))
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(checked)


def delete_vectors(chunks: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    out = chunks if ids is None else chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")
    return out if where is None else out.where(~F.coalesce(where, F.lit(False)))


def refreshed_vectors(old: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, changes) of a dictionary's vectors (id, text, vec) after ``entries`` (id, text, vec) became its content.

    ``changes`` (id, change) says which are new, changed, unchanged or stale; stale ones leave the table.
    """
    both = old.select("id", F.col("text").alias("was"), F.lit(True).alias("__old")).join(entries.select("id", "text", F.lit(True).alias("__new")), "id", "full_outer")
    change = F.when(F.col("__new").isNull(), "stale").when(F.col("__old").isNull(), "new").when(F.col("was").eqNullSafe(F.col("text")), "unchanged").otherwise("changed")
    changes = both.select("id", change.alias("change"))
    kept = old.join(changes.where("change = 'unchanged'"), "id", "left_semi")
    return kept.unionByName(entries.join(changes.where("change in ('new', 'changed')"), "id", "left_semi").select(kept.columns)), changes


def one_dimension(chunks: DataFrame) -> DataFrame:
    """(dims, ok): how many vector sizes there are; one is right."""
    return chunks.where("vec is not null and chunk_id is not null").agg(F.count_distinct(F.size("vec")).alias("dims")).withColumn("ok", F.col("dims") <= 1)


def dense_embeddings(docs: DataFrame, dim: int) -> DataFrame:
    """(doc_id, vec) of :func:`hash_embeddings` as whole vectors; texts without tokens have none."""
    slots = hash_embeddings(docs, dim).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    return slots.select("doc_id", F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def hash_embeddings(docs: DataFrame, dim: int) -> DataFrame:
    """(doc_id, slot, value): tokens of (doc_id, text) counted by the last bits of their md5, scaled to unit length.

    ``dim`` is a power of two up to 4096. Slots that no token falls into have no row.
    """
    if dim & (dim - 1) or not 0 < dim <= 4096:
        raise ValueError("dim is a power of two up to 4096")
    each = docs.select("doc_id", F.explode(tokens("text")).alias("term"))
    slot = F.pmod(F.conv(F.right(F.md5("term"), F.lit(3)), 16, 10).cast("int"), F.lit(dim))
    counts = each.groupBy("doc_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    norms = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, "doc_id").select("doc_id", "slot", (F.col("c") / F.col("norm")).alias("value"))
