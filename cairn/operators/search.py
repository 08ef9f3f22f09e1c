"""Search and browse over catalog items and vectors."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import YEARLY, generation_of, spaced, vector_id
from ..functions.unicode import natural_key
from ..session import written
from .ordered import numbered, rows_between

SEPARATOR = "\x1f"
# Labels and columns of the projection, in order, and how to reach names inside structs.
PROJECTION = (
    ("title", "title", None), ("description", "description", None), ("resource types", "types", None), ("category", "category", None), ("software type", "softwareType", None),
    ("programming languages", "programmingLanguages", None), ("licenses", "licenses", None), ("creators", "creators", "name"), ("part of", "partOf", None), ("related resources", "relatedTools", "title"),
)
SCALARS = ("description", "category", "canonicalUrl", "homepage", "sourceRepo", "namespaceURI", "latestVersion", "releaseDate", "partOf", "softwareType")
LISTS = ("types", "licenses", "programmingLanguages")
IDENTIFIERS = ("wikidataId", "canonicalUrl", "homepage", "sourceRepo", "namespaceURI", "latestVersion", "releaseDate")


def _values(items: DataFrame, column: str, inner: str | None) -> Column:
    """Sorted distinct clean texts of a scalar, an array, or an array of structs."""
    kind = items.schema[column].dataType.typeName()
    raw = F.col(column) if kind == "array" else F.array(F.col(column).cast("string"))
    texts = F.transform(raw, lambda v: spaced(v[inner] if inner else v))
    clean = F.filter(texts, lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def semantic_projection(items: DataFrame) -> DataFrame:
    """Adds ``projection``: a line ``label: a | b`` for each field that has values."""
    lines = []
    for label, column, inner in PROJECTION:
        if column in items.columns:
            values = _values(items, column, inner)
            lines.append(F.when(F.size(values) > 0, F.concat(F.lit(label + ": "), F.array_join(values, " | "))))
    return items.withColumn("projection", F.concat_ws("\n", *lines))


def identifier_values(items: DataFrame) -> DataFrame:
    """Adds ``identifiers``, lower-cased values for exact lookup."""
    found = [F.nullif(F.lower(spaced(F.col(c).cast("string"))), F.lit("")) for c in IDENTIFIERS if c in items.columns]
    return items.withColumn("identifiers", F.array_compact(F.array(*found)))


def vector_metadata(items: DataFrame, generation: Column) -> DataFrame:
    """P10: flat metadata: clean scalars, null for nothing, and lists joined by a unit separator."""
    plain = [F.nullif(spaced(F.col(c).cast("string")), F.lit("")).alias(c) for c in SCALARS if c in items.columns]
    lists = [F.nullif(F.array_join(_values(items, c, None), SEPARATOR), F.lit("")).alias(c) for c in LISTS if c in items.columns]
    return items.select(generation.alias("generationId"), "dataset", spaced("title").alias("title"), spaced("wikidataId").alias("wikidataId"), *plain, *lists)


def format_vector_result(metadata: DataFrame) -> DataFrame:
    """P10: lists are split again; older metadata used commas."""
    split = lambda c: F.filter(F.when(F.contains(c, F.lit(SEPARATOR)), F.split(c, SEPARATOR)).otherwise(F.split(c, ", ")), lambda v: v != "")
    return metadata.withColumns({c: split(F.col(c)) for c in LISTS if c in metadata.columns})


def _search_text(items: DataFrame, columns: tuple[str, ...]) -> Column:
    parts = []
    for column in columns:
        if column in items.columns:
            kind = items.schema[column].dataType
            value = F.array_join(F.col(column), " ") if kind.typeName() == "array" and kind.elementType.typeName() == "string" else F.col(column).cast("string")
            if kind.typeName() == "array" and kind.elementType.typeName() == "struct":
                names = ("name", "wikidataId") if "name" in kind.elementType.names else ("title", "canonicalUrl")
                value = F.array_join(F.flatten(F.transform(column, lambda v: F.array(v[names[0]], v[names[1]]))), " ")
            parts.append(F.when(F.trim(value) != "", value))
    return F.lower(F.concat_ws(" ", *parts))


BROWSE = ("title", "description", "wikidataId", "canonicalUrl", "homepage", "sourceRepo", "namespaceURI", "partOf", "category", "softwareType", "latestVersion", "releaseDate", "types", "licenses", "programmingLanguages", "creators", "relatedTools")
POSTING = ("title", "description", "hiringOrganization", "location", "sourceName", "salary")


def browse_search_text(items: DataFrame) -> DataFrame:
    """Adds ``search_text`` of an item's seventeen fields."""
    return items.withColumn("search_text", _search_text(items, BROWSE))


def posting_search_text(postings: DataFrame) -> DataFrame:
    """Adds ``search_text`` of a posting's six fields."""
    return postings.withColumn("search_text", _search_text(postings, POSTING))


def documentation_score(homepage: Column, repository: Column, licenses: Column) -> Column:
    """P13"""
    filled = lambda c: F.coalesce(c != "", F.lit(False)).cast("int")
    return 2 * filled(homepage) + 2 * filled(repository) + F.coalesce(F.size(licenses) > 0, F.lit(False)).cast("int")


def salary_rank(low: Column, high: Column, unit: Column) -> Column:
    """The middle of the finite bounds for a year; null without any."""
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    low, high = finite(low.cast("double")), finite(high.cast("double"))
    middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(low, high))
    times = F.create_map(*[F.lit(x) for pair in YEARLY.items() for x in pair])
    return middle * F.coalesce(times[F.lower(F.coalesce(unit, F.lit("")))], F.lit(1))


def remote_rank(remote: Column) -> Column:
    """Remote, on site, not reported."""
    return F.when(remote, 0).when(~remote, 1).otherwise(2)


def remote_label(remote: Column) -> Column:
    return F.when(remote, "Remote available").when(~remote, "On-site").otherwise("Not reported")


def best_search_term(title: Column, aliases: Column) -> Column:
    """The shortest of the names that look like an acronym (ten characters at most, three fifths upper case), else of all; the first of equals."""
    names = F.filter(F.concat(F.array(title), F.coalesce(aliases, F.array().cast("array<string>"))), lambda v: v.isNotNull() & (F.trim(v) != ""))
    acronym = lambda v: (F.length(v) <= 10) & (F.length(F.regexp_replace(v, "[^A-Z]", "")) >= 0.6 * F.length(F.regexp_replace(v, "[^A-Za-z]", ""))) & v.rlike("[A-Za-z]")
    short = F.filter(names, acronym)
    numbered = lambda a: F.array_min(F.transform(a, lambda v, i: F.struct(F.length(v).alias("n"), i.alias("i"), v.alias("v"))))["v"]
    return F.coalesce(numbered(short), numbered(names))


# ---- sorting and pages


def sort_keys(items: DataFrame, key: Column, order: str = "asc", numeric: bool = False, tie: str = "qid") -> tuple[DataFrame, list[tuple[str, bool]]]:
    """Items with the columns of W4's order, and that order: (column, descending)."""
    missing = key.isNull() if numeric else F.coalesce(F.trim(key.cast("string")) == "", F.lit(True))
    value = key if numeric else natural_key(key.cast("string"))
    named = items.withColumns({"_missing": missing, "_value": value, "_title": natural_key(F.coalesce("title", F.lit("")))})
    return named, [("_missing", False), ("_value", order == "desc"), ("_title", False), *([(tie, False)] if tie in items.columns else [])]


def sort_items(items: DataFrame, key: Column, order: str = "asc", numeric: bool = False, tie: str = "qid") -> DataFrame:
    """Missing values last either way; numbers and dates by value, texts naturally without case and accents; ties by title, then by the id ``tie``."""
    named, by = sort_keys(items, key, order, numeric, tie)
    return named.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in by)).drop("_missing", "_value", "_title")


def page_of(total: int, page: int, size: int = 50) -> tuple[int, int]:
    """The page within bounds, and the number of pages."""
    pages = max(1, -(-total // size))
    return min(max(1, page), pages), pages


def paginate(items: DataFrame, by: list[tuple[str, bool]], page: int, size: int = 50) -> DataFrame:
    """One page of a table in the order ``by`` (column, descending), the last one for numbers beyond it; earlier pages are counted, not sorted (``rows_between``)."""
    at, _ = page_of(items.count(), page, size)
    return rows_between(items, by, (at - 1) * size, at * size)


def limit_results(results: DataFrame, limit: int | None, default: int = 20, most: int = 50) -> DataFrame:
    """W6"""
    return results.limit(max(1, min(default if limit is None else limit, most)))


def _terms(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(spaced(query)), " "), lambda t: t != ""))


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters, in time linear in the text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    runs = F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda i: F.array_join(F.slice(chars, i + 1, size), ""))
    return F.when(F.size(chars) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


GRAM = 3


#: Grams, and pairs of them, of all queries that tasks look for at once; for more, they emit all grams of a text, and a join leaves the wanted ones.
GRAMS = 1_000_000


def gram_index(items: DataFrame, wanted: DataFrame, counts: bool = False) -> DataFrame:
    """``gram, position``: the inverted index of ``_low`` texts, of the grams in ``wanted`` (``gram``); or ``gram, count`` of each task."""
    rows = [r[0] for r in wanted.limit(GRAMS + 1).collect()]
    few = len(rows) <= GRAMS
    sizes = sorted({len(g) for g in rows}) if few else [1, 2, GRAM]
    shared = items.sparkSession.sparkContext.broadcast(frozenset(rows) if few else None)

    def run(batches):
        for batch in batches:
            places, found = [], []
            for i, text in enumerate(batch.column("_low").to_pylist()):
                own = {text[j : j + n] for n in sizes for j in range(len(text) - n + 1)} if text else ()
                if few and own:
                    own &= shared.value
                places += [i] * len(own)
                found += own
            if counts:
                many = Counter(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.string()), pa.array(list(many.values()), pa.int64())], ["gram", "count"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column("position").take(pa.array(places, pa.int64()))], ["gram", "position"])

    index = items.select("position", "_low").mapInArrow(run, "gram string, count bigint" if counts else f"gram string, position {items.schema['position'].dataType.simpleString()}")
    return index if few else index.join(wanted, "gram", "left_semi")


def pair_index(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """``first, next, position`` of items whose ``_low`` text holds both grams of a pair in ``wanted`` (``first, next``; next may be null: the first alone)."""
    rows = wanted.limit(GRAMS + 1).collect()
    if len(rows) > GRAMS:
        one = gram_index(items, wanted.select(F.col("first").alias("gram")).distinct())
        two = written(gram_index(items, wanted.select(F.col("next").alias("gram")).filter("next is not null").distinct()), "postings").withColumnRenamed("gram", "next")
        met = wanted.join(one.withColumnRenamed("gram", "first"), "first").select("first", "next", "position")
        return met.join(two, ["next", "position"], "left_semi").select("first", "next", "position").unionByName(met.filter("next is null"))
    after: dict[str, set] = {}
    for first, second in rows:
        after.setdefault(first, set()).add(second)
    sizes = sorted({len(g) for row in rows for g in row if g is not None})
    shared = items.sparkSession.sparkContext.broadcast(after)

    def run(batches):
        after = shared.value
        for batch in batches:
            places, firsts, seconds = [], [], []
            for i, text in enumerate(batch.column("_low").to_pylist()):
                own = {text[j : j + n] for n in sizes for j in range(len(text) - n + 1)} if text else set()
                own.add(None)
                for first in own & after.keys():
                    for second in own & after[first]:
                        places.append(i)
                        firsts.append(first)
                        seconds.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.string()), pa.array(seconds, pa.string()), batch.column("position").take(pa.array(places, pa.int64()))], ["first", "next", "position"])

    return items.select("position", "_low").mapInArrow(run, f"first string, next string, position {items.schema['position'].dataType.simpleString()}")


def text_candidates(items: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, position`` of items (``position, _low``) that may hold all ``_terms`` of a query: a superset, by the index.

    A query's grams are those of three letters of its terms, and terms of one or two letters as they are.  The rarest gram, and the rarest one of another term (or else of the same), are
    looked for together in each text, so no step is larger than the items that hold both.  A query with a gram that no item has has no candidate.
    """
    of_term = lambda t, i: F.transform(F.when(F.length(t) < GRAM, F.array(t)).otherwise(grams(t, GRAM)), lambda g: F.struct(g.alias("gram"), i.alias("term")))
    own = written(asked.select("query_id", F.explode(F.flatten(F.transform("_terms", of_term))).alias("g")).select("query_id", "g.gram", "g.term"), "query-grams")
    counted = gram_index(items, own.select("gram").distinct(), True).groupBy("gram").agg(F.sum("count").alias("count"))
    counted = own.join(counted, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    first = counted.groupBy("query_id").agg(F.min(F.struct("count", "gram", "term")).alias("f"), F.min("count").alias("least")).filter("least > 0")
    other = counted.join(first, "query_id").filter("gram <> f.gram").groupBy("query_id").agg(F.min(F.struct((F.col("term") == F.col("f.term")).alias("same"), "count", "gram")).alias("s"))
    pairs = written(first.join(other, "query_id", "left").select("query_id", F.col("f.gram").alias("first"), F.col("s.gram").alias("next")), "query-pairs")
    found = pair_index(items, pairs.select("first", "next").distinct())
    same = (pairs["first"] == found["first"]) & pairs["next"].eqNullSafe(found["next"])
    return pairs.join(found, same).select("query_id", "position").distinct()


def _asked_once(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One query of each kind under an id of its own, ``first``, and ``query_id, first`` of all: equal queries have equal results."""
    keyed = written(asked.withColumn("first", F.sha2(F.to_json(F.struct(*(c for c in asked.columns if c != "query_id"))), 256)), "asked")
    return keyed.dropDuplicates(["first"]).withColumn("query_id", F.col("first")).select(*asked.columns), keyed.select("query_id", "first").distinct()


def _for_all(found: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(found.withColumnRenamed("query_id", "first"), "first").select("query_id", "position", "total", "rank")


def _limited(matches: DataFrame, limit: int) -> DataFrame:
    """Each query's first ``limit`` positions, ``rank``, and ``total``, which is counted before they are ranked: no window holds all matches of a query."""
    matches = written(matches, "matches")
    first = matches.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("rank") <= limit)
    return first.join(matches.groupBy("query_id").agg(F.count("*").alias("total")), "query_id").select("query_id", "position", "total", "rank")


def text_search(items: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Q1: ``query_id, position, total, rank`` of items that hold an identifier equal to the query or all its words.

    ``items`` has ``position, projection, identifiers, category, dataset``; ``queries(query_id, q, category, dataset)`` is a batch of questions.  Candidates come
    from an index of the projections' letters (``text_candidates``) and, by an equi-join, from identifiers; each is then verified on the whole text.  Categories compare without case; the total counts before the limit.
    """
    asked = queries.select("query_id", F.lower(spaced("q")).alias("_q"), _terms(F.col("q")).alias("_terms"), F.lower("category").alias("_category"), F.col("dataset").alias("_dataset")).filter("_q <> ''")
    asked, every = _asked_once(asked)
    low = written(items.select("position", F.lower("projection").alias("_low"), "identifiers", "category", "dataset"), "texts")  # made once, read by each step
    named = low.select("position", F.explode("identifiers").alias("_q")).join(asked.select("query_id", "_q"), "_q").select("query_id", "position")
    candidates = named.unionByName(text_candidates(low, asked)).distinct()
    hit = F.array_contains("identifiers", F.col("_q")) | F.forall("_terms", lambda t: F.contains("_low", t))
    fits = (F.col("_category").isNull() | (F.lower("category") == F.col("_category"))) & (F.col("_dataset").isNull() | (F.col("dataset") == F.col("_dataset")))
    return _for_all(_limited(candidates.join(asked, "query_id").join(low, "position").filter(hit & fits).select("query_id", "position"), limit), every)


def text_search_plain(items: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Q2: words only, no identifiers; the total counts what the limit leaves."""
    asked = queries.select("query_id", _terms(F.col("q")).alias("_terms"), F.lower("category").alias("_category")).filter(F.size("_terms") > 0)
    asked, every = _asked_once(asked)
    low = written(items.select("position", F.lower("projection").alias("_low"), "category"), "texts")
    fits = F.col("_category").isNull() | (F.lower("category") == F.col("_category"))
    hit = F.forall("_terms", lambda t: F.contains("_low", t))
    found = _limited(text_candidates(low, asked).join(asked, "query_id").join(low, "position").filter(hit & fits).select("query_id", "position"), limit)
    return _for_all(found.withColumn("total", F.count("*").over(Window.partitionBy("query_id"))), every)


SORTS = {"title": False, "releaseDate": True, "documentationScore": True}


def browse(items: DataFrame, q: str = "", category: str | None = None, sort: str = "title", order: str = "asc", page: int = 1, size: int = 50) -> DataFrame:
    """Q3: facet, all words, order, page; unknown sorts and orders fall back to the defaults."""
    sort, order = sort if sort in SORTS and sort in items.columns else "title", order if order in ("asc", "desc") else "asc"
    found = items if category is None else items.filter(F.col("category") == category)
    for word in q.lower().split():
        found = found.filter(F.contains("search_text", F.lit(word)))
    named, by = sort_keys(found, F.col(sort), order, SORTS[sort])
    return paginate(written(named, "found"), by, page, size).drop("_missing", "_value", "_title")  # the page is found in several passes; texts and keys are made in one


# ---- vectors


#: Vectors that centroids are fitted on, most lists, vectors and queries of a task.
SAMPLE, CENTROIDS, BLOCK, ASKED = 4_000, 256, 32_768, 4_096


def _unit(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and their norms."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return rows, np.sqrt((rows * rows).sum(1))


def _fitted(sample: np.ndarray, norms: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Directions of unit length by spherical k-means from evenly spaced rows."""
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    now = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ now.T).argmax(1)
        sums = np.zeros_like(now)
        np.add.at(sums, nearest, unit)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        now = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), now)
    return now


def _angles(rows: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Angles of rows to centroids; zero vectors are at a right angle to everything, as their score is zero."""
    return np.where(norms[:, None] > 0, np.arccos(np.clip(rows @ centroids.T / np.maximum(norms, 1e-300)[:, None], -1, 1)), np.pi / 2)


def vector_lists(vectors: DataFrame, centroids: np.ndarray, keep: list[str]) -> DataFrame:
    """Every row with its ``list``, the nearest centroid, and ``angle`` to it: the inverted lists."""

    def run(batches):
        for batch in batches:
            rows, norms = _unit(batch.column("values"))
            angle = _angles(rows, norms, centroids) if len(rows) else np.zeros((0, 1))
            near = angle.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(near)), near])], [*batch.schema.names, "list", "angle"])

    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return vectors.select(*keep).mapInArrow(run, f"{fields}, list int, angle double")


def _best_of_list(asked: pa.Table, rows: pa.Table, k: int, by: list[str]) -> pa.Table:
    """The ``k`` best rows of one block of a list for each query, among those that the triangle inequality leaves: an angle between two vectors is at least the difference of theirs to the centroid."""
    queries, own = _unit(asked.column("values"))
    vectors, norms = _unit(rows.column("values"))
    angle, to, floor = rows.column("angle").to_numpy(), asked.column("angle").to_numpy(), asked.column("floor").to_numpy()
    fits = [(asked.column(c).to_pylist(), np.array(rows.column(c).to_pylist(), object)) for c in by]
    names = np.array(rows.column("id").to_pylist(), object)
    out, compared = ([], [], []), []
    for i in range(len(queries)):
        bound = np.cos(np.abs(angle - to[i])) + 1e-9
        take = (bound >= floor[i]) | (norms == 0) | (own[i] == 0)
        for asks, has in fits:
            if asks[i] is not None:
                take &= has == asks[i]
        place = np.flatnonzero(take)
        scale = norms[place] * own[i]
        # Summed row by row, not by a matrix product, so equal vectors have equal scores wherever they stand.
        score = np.where(scale > 0, (vectors[place] * queries[i]).sum(1) / np.where(scale > 0, scale, 1.0), 0.0) if len(place) else np.zeros(0)
        if len(score) > k:
            least = np.partition(score, -k)[-k]
            held = score >= least
            place, score = place[held], score[held]
        order = sorted(range(len(place)), key=lambda j: (-score[j], names[place[j]]))[:k]
        out[0].extend([asked.column("query_id")[i].as_py()] * len(order))
        out[1].extend(names[place[order]].tolist())
        out[2].extend(score[order].tolist())
        compared.append(int(take.sum()))
    return pa.table([pa.array(out[0], asked.schema.field("query_id").type), pa.array(out[1], rows.schema.field("id").type), pa.array(out[2], pa.float64()), pa.array(_counted(compared, out[0], asked), pa.int64())], ["query_id", "id", "score", "compared"])


def _counted(compared: list[int], found: list, asked: pa.Table) -> list[int]:
    """The pairs compared of each query, on its first row; zero on others."""
    left = dict(zip(asked.column("query_id").to_pylist(), compared))
    return [left.pop(q, 0) for q in found]


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, generation: str | None = None, by: list[str] | None = None, compared: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest by cosine, ties by id, exactly; ``by``: columns that a query may fix (null: any).

    Inverted lists around centroids hold every vector; the centroids are fitted on ``SAMPLE`` vectors, about the root of their number, ``CENTROIDS`` at most.  A query first reads
    its own list, which gives a score that its k-th result reaches at least; then only those lists, and in them only those vectors, whose angle to the centroid allows that score, by the triangle
    inequality.  Vectors without structure, such as random ones of many dimensions, allow it nearly everywhere: then all pairs are compared, in blocks.  A list of more than ``BLOCK`` vectors is several
    blocks, so a hot list is no task.  Zero vectors have the score 0; rows without a vector, or with a null or NaN component, take no part.  ``compared`` adds the pairs that were compared, for each query.
    """
    by = list(by or ())
    pool = vectors if generation is None else vectors.filter(F.col("namespace") == generation)
    whole = F.coalesce(F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    pool = pool.select("id", "values", *by).filter(whole)
    total = pool.count()
    sample, norms = _unit(pool.select("values").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("values"))
    if not total or not sample.shape[1]:
        empty = queries.select("query_id", F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).filter("false")
        return empty.withColumn("compared", F.lit(0).cast("bigint")) if compared else empty
    centroids = _fitted(sample, norms, min(CENTROIDS, int(np.ceil(np.sqrt(total) / 2))))
    lists = written(vector_lists(pool, centroids, ["id", "values", *by]), "lists")
    counts, least, most = np.ones(len(centroids), int), np.full(len(centroids), 9.0), np.full(len(centroids), 9.0)
    for at, n, low, high in lists.groupBy("list").agg(F.count("*"), F.min("angle"), F.max("angle")).collect():  # a row a list
        counts[at], least[at], most[at] = -(-n // BLOCK), low, high
    of_list = lambda values: F.element_at(F.array(*(F.lit(v) for v in values.tolist())), F.col("list") + 1)

    def run(batches):
        for batch in batches:
            rows, own = _unit(batch.column("values"))
            angle = _angles(rows, own, centroids) if len(rows) else np.zeros((0, len(centroids)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(angle) + 1, dtype=np.int32) * len(centroids)), pa.array(angle.ravel()))
            yield batch.append_column("angles", flat).append_column("home", pa.array(angle.argmin(1).astype(np.int32)))

    names = ["query_id", "values", *by]
    fields = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in names)
    asked = queries.select(*names).filter(whole).mapInArrow(run, f"{fields}, angles array<double>, home int")
    parts = max(1, -(-queries.count() // ASKED))
    rows = lists.withColumn("block", F.pmod(F.xxhash64("id"), of_list(counts)).cast("int"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double, compared bigint"

    def searched(wanted: DataFrame) -> DataFrame:
        """Of ``wanted``, queries with a ``list``, the ``angle`` to it, and a ``floor``."""
        dealt = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), of_list(counts) - 1)))
        dealt = dealt.select(*names, "list", "block", "floor", "angle", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
        spread = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = dealt.groupBy("list", "block", "part").cogroup(spread.groupBy("list", "block", "part"))
        return found.applyInArrow(lambda left, right: _best_of_list(left, right, k, by), kinds)

    at_home = asked.withColumn("list", F.col("home")).withColumns({"floor": F.lit(-2.0), "angle": F.element_at("angles", F.col("list") + 1)})
    near = written(searched(at_home), "near")
    top = lambda rows_: rows_.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)
    kth = top(near).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("its_floor"))
    known = asked.join(kth.withColumnRenamed("query_id", "its_id"), F.col("query_id") == F.col("its_id"), "left").withColumn("floor", F.coalesce("its_floor", F.lit(-2.0)))
    others = known.select(*names, "home", "floor", F.posexplode("angles").alias("list", "angle")).filter("list <> home")
    # An angle to any vector of a list is at least what the list's range of angles leaves.
    others = others.filter(F.cos(F.greatest(F.lit(0.0), F.col("angle") - of_list(most), of_list(least) - F.col("angle"))) + 1e-9 >= F.col("floor"))
    found = near.unionByName(searched(others))
    if not compared:
        return top(found).select("query_id", "id", "score", "rank")
    found = written(found, "found")
    return top(found).select("query_id", "id", "score", "rank").join(found.groupBy("query_id").agg(F.sum("compared").alias("compared")), "query_id")


def representatives(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The first vector of each dataset, and whether it is among its own nearest ``k``."""
    first = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy("id"))).filter("_n = 1")
    near = vector_top_k(first.select(F.col("id").alias("query_id"), "values", "dataset"), vectors, k, by=["dataset"])
    own = near.filter("query_id = id").select(F.col("query_id").alias("id"), F.lit(True).alias("_found"))
    return first.select("dataset", "id").join(own, "id", "left").select("dataset", "id", F.coalesce("_found", F.lit(False)).alias("found"))


def semantic_search(queries: DataFrame, vectors: DataFrame, generation: str, k: int = 20, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q4: the nearest vectors of a generation's namespace, and violations: results whose id is of another generation."""
    found = vector_top_k(queries, vectors, k, generation, by)
    strangers = found.filter(~generation_of("id").eqNullSafe(F.lit(generation)))
    return found, strangers.select(F.lit("wrong-generation").alias("code"), F.lit("error").alias("severity"), F.col("id").alias("subject"))


def embed_items(items: DataFrame, generation: str, embed) -> DataFrame:
    """``id, namespace, values, metadata`` by a caller's function from a list of projections to a list of vectors; counts must match."""
    from ..functions.columns import qid

    named = semantic_projection(items).select(vector_id(F.lit(generation), "dataset", qid("wikidataId")).alias("id"), "projection")

    def run(batches):
        import pandas as pd

        for batch in batches:
            values = embed(batch["projection"].tolist())
            if len(values) != len(batch):
                raise ValueError(f"{len(values)} vectors for {len(batch)} items")
            yield pd.DataFrame({"id": batch["id"], "namespace": generation, "values": [list(map(float, v)) for v in values], "projection": batch["projection"]})

    return named.mapInPandas(run, "id string, namespace string, values array<float>, projection string")


# ---- generations


def latest_ready(states: DataFrame, wanted: str) -> DataFrame:
    """``ready, generation_id, reason``: the wanted generation if it is ready, else the ready one verified last."""
    own = states.agg(F.max(F.when(F.col("generation_id") == wanted, F.col("status"))).alias("own"), F.max_by(F.when(F.col("status") == "ready", F.col("generation_id")), F.when(F.col("status") == "ready", F.col("verified_at"))).alias("latest"))
    ready = F.coalesce(F.col("own") == "ready", F.lit(False))
    reason = F.when(ready, F.lit(None).cast("string")).when(F.col("own").isNotNull() | F.col("latest").isNull(), "index-not-ready").otherwise("generation-mismatch")
    return own.select(ready.alias("ready"), F.when(ready, F.lit(wanted)).otherwise(F.col("latest")).alias("generation_id"), reason.alias("reason"))


RETIRED = ("status", "retirement_mutation_ids", "retired_at", "failure_reason")


def merge_generation_state(states: DataFrame, updates: DataFrame, retire: bool = False) -> DataFrame:
    """States with updates by ``generation_id``; a null in an update keeps the old value, and retiring touches only its four columns."""
    old, new = states.alias("old"), updates.alias("new")
    joined = old.join(new, F.col("old.generation_id") == F.col("new.generation_id"), "left" if retire else "full")
    columns = []
    for c in states.columns:
        takes = c in updates.columns and (not retire or c in RETIRED)
        columns.append((F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if takes else F.col(f"old.{c}")).alias(c))
    return joined.select(*columns)


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``id, state``: missing, unexpected, duplicate."""
    have = actual.groupBy("id").count()
    both = expected.select("id").distinct().withColumn("_want", F.lit(True)).join(have, "id", "full")
    states = F.array_compact(F.array(F.when(F.col("count").isNull(), F.lit("missing")), F.when(F.col("_want").isNull(), F.lit("unexpected")), F.when(F.col("count") > 1, F.lit("duplicate"))))
    return both.select("id", F.explode(states).alias("state"))


def obsolete_generations(vectors: DataFrame, retained: DataFrame, batch: int = 100) -> DataFrame:
    """``generation_id, id, batch`` of qualified ids of generations that are not retained (``generation_id, ready``).

    A retained generation that is not ready refuses the whole operation.  Ids are numbered by one sort over all tasks, so a generation of all vectors is no task of its own.
    """
    if not 1 <= batch <= 100:
        raise ValueError("a batch has 1 to 100 ids")
    if not retained.filter("not ready").isEmpty():
        raise ValueError("a retained generation is not ready")
    named = vectors.select("id", generation_of("id").alias("generation_id")).filter("generation_id is not null")
    gone = named.join(retained.select("generation_id"), "generation_id", "left_anti")
    counted = numbered(gone, "generation_id", "id")
    return counted.select("generation_id", "id", F.floor((F.col("number") - 1) / batch).cast("bigint").alias("batch"))


def check_vectors(vectors: DataFrame, expected: DataFrame, generation: str) -> DataFrame:
    """``code, subject``: wrong namespace, generation or dataset of a vector, and what differs from the expected ids."""
    parts = F.regexp_extract("id", r"^.+:(ontologies|software):Q\d+$", 1)
    wrong = F.array_compact(F.array(
        F.when(~F.col("namespace").eqNullSafe(F.lit(generation)), F.lit("wrong-namespace")),
        F.when(~generation_of("id").eqNullSafe(F.lit(generation)), F.lit("wrong-generation")),
        F.when(~F.col("dataset").eqNullSafe(parts), F.lit("wrong-dataset")),
    ))
    rows = vectors.select(F.explode(wrong).alias("code"), F.col("id").alias("subject"))
    return rows.unionByName(inventory_diff(expected, vectors).select(F.concat(F.col("state"), F.lit("-vector")).alias("code"), F.col("id").alias("subject")))
