"""Full-text reads over weighted postings.

A document's vector has its symbol name with weight A, its path with B and its text with C. A
query matches documents that hold all its words. The rank is a closed form, the sum over
query words and fields of weight times log2(1 + occurrences); search results are scaled by
their maximum afterwards, so only order and ratios matter. Words are folded, lower-case runs
of letters and digits; no stemming and no stop-words by default, both are parameters of the
text functions that feed the postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvale.functions.text import fold_accents

#: Field weights of the classes A, B and C.
WEIGHTS = {"symbol_name": 1.0, "path": 0.4, "doc": 0.2}
POSTING = "repo_id string, id string, term string, field string, occurrences long"
WORD = re.compile("[a-z0-9]+")
#: Postings in a batch that Python hands back.
OUT_ROWS = 50_000
#: Characters of questions that every task may hold.
ASKED_CHARS = 16_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), 0)


def query_terms(text: str) -> list[str]:
    """Distinct words of a query, folded like the documents."""
    from corvale.functions.inventory_terms import plain_token

    return list(dict.fromkeys(re.findall("[a-z0-9]+", plain_token(text))))


def _folded(corpus: DataFrame) -> DataFrame:
    """repo_id, id and the fields of a corpus, lower-case and without marks, as terms() sees them."""
    return corpus.select("repo_id", "id", *[fold_accents(F.lower(F.coalesce(F.col(f), F.lit("")))).alias(f) for f in WEIGHTS])


def _counts(row: dict) -> dict[str, Counter]:
    return {f: Counter(WORD.findall(row[f])) for f in WEIGHTS}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded rows to postings, each row by itself."""
    schema = pa.schema([("repo_id", pa.string()), ("id", pa.string()), ("term", pa.string()), ("field", pa.string()), ("occurrences", pa.int64())])
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row in _rows(batch):
            for field, words in _counts(row).items():
                n = len(words)
                for column, values in zip(out, ([row["repo_id"]] * n, [row["id"]] * n, words.keys(), [field] * n, words.values())):
                    column.extend(values)
            if len(out[0]) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, schema)], schema=schema)
                out = [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, schema)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    columns = [batch.column(n) for n in range(len(names))]
    for at in range(batch.num_rows):
        yield {name: column[at].as_py() for name, column in zip(names, columns)}


def _ids_repeat(corpus: DataFrame) -> bool:
    return not corpus.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def postings(corpus: DataFrame) -> DataFrame:
    """(repo_id, id, term, field, occurrences) of a corpus: the index to write bucketed by term.

    Words are counted row by row, without a shuffle; only if an id comes in several rows their counts are added up."""
    counted = _folded(corpus).mapInArrow(_count, POSTING)
    if not _ids_repeat(corpus):
        return counted
    return counted.groupBy("repo_id", "id", "term", "field").agg(F.sum("occurrences").alias("occurrences"))


def _is(word: str):
    return lambda t: t == word


def _rank(words: list[str]) -> Column:
    """The rank of a row that has its words in terms_<field> columns; null if one of the query's words is missing."""
    score, every = F.lit(0.0), F.lit(True)
    for word in words:
        found = F.lit(0)
        for field, weight in WEIGHTS.items():
            n = F.size(F.filter(F.col(f"terms_{field}"), _is(word)))
            score = score + F.lit(weight) * F.log2(1 + n)
            found = found + n
        every = every & (found > 0)
    return F.when(every, score)


def search(corpus: DataFrame, repo: str, text: str, top_n: int = 50) -> DataFrame:
    """The top_n documents of a repository that hold all words of text, with score; whole-file rows do not count. Blank text finds nothing."""
    words = query_terms(text)
    own = corpus.where((F.col("repo_id") == repo) & (F.col("entity_type") != "file_full"))
    if not words:
        return own.withColumn("score", F.lit(0.0)).limit(0)
    hay = fold_accents(F.lower(F.concat_ws(" ", *WEIGHTS)))
    every = lambda h: reduce(and_, [F.contains(h, F.lit(word)) for word in words])
    own = own.where(F.element_at(F.transform(F.array(hay), every), 1))  # necessary, and the text is folded once: cut before texts are split into words
    split = own.withColumns({f"terms_{f}": terms(F.col(f)) for f in WEIGHTS})
    ranked = split.withColumn("score", _rank(words)).drop(*[f"terms_{f}" for f in WEIGHTS])
    return ranked.orderBy(F.desc("score"), "id").limit(top_n).where("score IS NOT NULL")  # nulls come last; a filter before would rank twice


def search_many(index: DataFrame, queries: DataFrame, top_n: int = 50) -> DataFrame:
    """(query_id, id, score, rank) for a table of queries (query_id, repo_id, text) over written postings."""
    asked = queries.select("query_id", "repo_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    return _best(asked.join(index, ["repo_id", "term"]), wanted, top_n)


def _best(met: DataFrame, wanted: DataFrame, top_n: int) -> DataFrame:
    """The top_n of each query among the documents whose postings it met, all of its words."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    hits = met.groupBy("query_id", "id").agg(F.count_distinct("term").alias("found"), F.sum(weight[F.col("field")] * F.log2(1 + F.col("occurrences"))).alias("score"))
    full = hits.join(wanted, "query_id").where("found = wanted").drop("found", "wanted")
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= top_n)


def search_corpus(corpus: DataFrame, queries: DataFrame, top_n: int = 50) -> DataFrame:
    """As search_many, over a corpus whose postings are not written: each row is counted and asked at once, and only postings of
    rows that hold all words of a question leave their task.

    A question is looked up by its rarest word (over the questions) and its other words are then tried in turn. Ids in several
    rows, and questions too large for every task to hold, take the way over the postings."""
    asked = queries.select("query_id", "repo_id", F.array_distinct(terms(F.col("text"))).alias("words")).where("size(words) > 0")
    size = asked.agg(F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0))).first()[0]
    if size > ASKED_CHARS or _ids_repeat(corpus) or asked.groupBy("query_id").count().where("count > 1").count():
        return search_many(postings(corpus), queries, top_n)
    rows = [tuple(r) for r in asked.select("query_id", "repo_id", "words").collect()]
    use = Counter(w for *_, words in rows for w in words)
    by_word: dict[tuple, list] = {}
    for query, repo, words in rows:
        first, *rest = sorted(words, key=lambda w: (use[w], -len(w), w))
        by_word.setdefault((repo, first), []).append((query, words, rest))
    shipped = corpus.sparkSession.sparkContext.broadcast(by_word)
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, id string, term string, field string, occurrences long"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            out = []
            for row in _rows(batch):
                counts = _counts(row)
                held = set().union(*counts.values())
                for word in held:
                    for query, words, rest in known.get((row["repo_id"], word), ()):
                        if all(w in held for w in rest):
                            out += [(query, row["id"], w, f, c[w]) for w in words for f, c in counts.items() if w in c]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "id", "term", "field", "occurrences"), x)) for x in out], schema=to_arrow_schema(met_schema))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    met_schema = StructType.fromDDL(schema)
    wanted = asked.select("query_id", F.size("words").cast("long").alias("wanted"))
    return _best(_folded(corpus).mapInArrow(meet, schema), wanted, top_n)


def file_document(corpus: DataFrame, repo: str, path: str, entity_type: str = "file_full") -> DataFrame:
    return corpus.where((F.col("repo_id") == repo) & (F.col("path") == path) & (F.col("entity_type") == entity_type)).orderBy("id").limit(1)


def symbol_document(corpus: DataFrame, repo: str, path: str, name: str) -> DataFrame:
    return corpus.where((F.col("repo_id") == repo) & (F.col("path") == path) & (F.col("symbol_name") == name) & (F.col("entity_type") == "symbol")).orderBy("id").limit(1)


def has_corpus(corpus: DataFrame, repo: str) -> bool:
    return not corpus.where(F.col("repo_id") == repo).isEmpty()


def snippets(wanted: DataFrame, vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """For (repo_id, path, symbol_name): the snippet of the vector store, else of the corpus; source tells which."""
    key = ["repo_id", "path", "symbol_name"]
    first = vectors.select(*key, F.col("doc").alias("snippet"), F.lit("vector").alias("source"), F.lit(0).alias("priority"), "id")
    second = corpus.where("entity_type = 'symbol'").select(*key, F.col("doc").alias("snippet"), F.lit("lexical").alias("source"), F.lit(1).alias("priority"), "id")
    found = wanted.select(*key).distinct().join(first.unionByName(second), key)
    best = found.groupBy(*key).agg(F.min_by(F.struct("snippet", "source"), F.struct("priority", "id")).alias("best"))
    return best.select(*key, "best.snippet", "best.source")
