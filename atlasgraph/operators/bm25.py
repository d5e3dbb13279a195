"""BM25 topic recall: an inverted index as tables, batches of questions scored by joins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import drop_stop_words, may_be_in, zh_terms
from ..session import stored
from .context import BUDGET, within_budget

K1, B, MIN_SCORE, TOP = 1.5, 0.75, 1.0, 8


@dataclass
class Index:
    """postings (term, id, tf, weight), df (term, df), docs (id, dl), stats (one row: n_docs, avgdl)."""

    postings: DataFrame
    df: DataFrame
    docs: DataFrame
    stats: DataFrame


def node_documents(nodes: DataFrame) -> DataFrame:
    """(id, label, name, text) of the nodes that make documents: concepts with name, description, aliases and quotes,
    commits with a message, modules with a docstring, functions and classes with a Chinese description."""

    def col(c):
        return F.col(c) if c in nodes.columns else F.lit(None).cast("string")

    def arr(c):
        return F.col(c) if c in nodes.columns else F.lit(None).cast("array<string>")

    quotes = F.transform("evidence", lambda e: e["quote"]) if "evidence" in nodes.columns else F.lit(None).cast("array<string>")
    filled = lambda *parts: F.array_join(F.filter(F.concat(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    some = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    concept = filled(F.array(col("name"), col("description")), some(arr("aliases")), some(arr("zh_aliases")), some(quotes))
    card = F.when(F.trim(F.coalesce(col("zh_desc"), F.lit(""))) != "", filled(F.array(col("zh_desc")), some(arr("zh_aliases"))))
    text = F.when(F.col("label") == "Concept", concept).when(F.col("label") == "Commit", col("message")).when(F.col("label") == "Module", col("docstring")).when(F.col("label").isin("Function", "Class"), card)
    last = F.substring_index("id", "::", -1)
    name = F.when(F.col("label") == "Commit", F.substring(F.coalesce(col("hash"), last), 1, 8)).when(F.col("label").isin("Function", "Class"), F.coalesce(col("qualname"), col("name"), last)).otherwise(F.coalesce(col("name"), last))
    return nodes.select("id", "label", name.alias("name"), text.alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")


def build_index(documents: DataFrame, persist: bool = True, wanted: DataFrame | None = None) -> Index:
    """Index of (id, text). A document without terms isn't part of the corpus; repeated terms count.

    With wanted (term) only these terms get postings: a batch of questions then shuffles its own terms instead of all of
    the corpus's, and lengths and statistics are still those of all documents. One pass over the texts serves both, as a
    document's length travels as a row with an empty term, which no text has.
    """
    terms = documents.where("text is not null").select("id", zh_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    if wanted is None:
        tf = terms.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        tf = stored(tf, "bm25-tf") if persist else tf
        docs = tf.groupBy("id").agg(F.sum("tf").alias("dl"))
    else:
        each = terms.select("id", F.size("terms").cast("long").alias("dl"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
        some = wanted.select("term").unionByName(documents.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        rows = stored(each.join(some, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "bm25-tf")
        docs = rows.where("term = ''").select("id", "dl")
        tf = rows.where("term <> ''").select("id", "term", "tf")
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # A posting's share of the score depends on the corpus alone, so it is worked out once.
    one = F.broadcast(stats)  # one row
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
    postings = tf.join(docs, "id").join(df, "term").crossJoin(one).select("term", "id", "tf", weight.alias("weight"))
    return Index(stored(postings, "bm25-postings") if persist else postings, df, docs, stats)


@dataclass
class Texts:
    """documents (id, dl, terms): what a batch of questions is scored against without an index."""

    documents: DataFrame


def texts(documents: DataFrame) -> Texts:
    """The documents (id, text) that have terms, with them in a list each, so a term isn't a row."""
    terms = documents.where("text is not null").select("id", zh_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    return Texts(stored(terms.select("id", F.size("terms").cast("long").alias("dl"), "terms"), "bm25-texts"))


def search(documents: DataFrame, questions: DataFrame, k: int = TOP, min_score: float = MIN_SCORE, key: str = "qid") -> DataFrame:
    """topic_recall of one batch of questions over documents (id, text) that have no index yet."""
    return topic_recall(texts(documents), questions, k, min_score, key)


BLOCK = 10_000  # documents of a block


def _scores(docs: pa.Table, asked: pa.Table):
    """Of each question (words, idf, avgdl) in turn its number and the scores of all of a block's documents (terms, dl)."""
    lists, q = pc.split_pattern(docs["terms"].combine_chunks(), " "), asked["words"].combine_chunks()
    vocabulary = pc.unique(q.flatten())
    q_term, q_end = pc.index_in(q.flatten(), vocabulary).to_numpy(), np.cumsum(pc.list_value_length(q).to_numpy())
    idf = asked["idf"].combine_chunks().flatten().to_numpy()
    at = pc.index_in(lists.flatten(), vocabulary)
    here = pc.is_valid(at).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[here]
    pair, tf = np.unique(pc.drop_null(at).to_numpy().astype(np.int64) * len(lists) + doc, return_counts=True)
    term, doc = pair // len(lists), pair % len(lists)
    part = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * docs["dl"].to_numpy()[doc] / asked["avgdl"][0].as_py()))
    start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    begin = 0
    for i, end in enumerate(q_end):
        total = np.zeros(len(lists))
        for j in range(begin, end):
            a, b = start[q_term[j]], start[q_term[j] + 1]
            total[doc[a:b]] += idf[j] * part[a:b]
        begin = end
        yield i, total


def _block_best(k: int, key: str):
    """Of a block's documents and all questions (terms, idf, avgdl) the k best of each question, and those that differ from
    the last of them by less than rounding does."""

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([asked.schema.field(key), docs.schema.field("id"), pa.field("score", pa.float64())])
        if not docs.num_rows or not asked.num_rows:
            return kinds.empty_table()
        out = []
        for i, total in _scores(docs, asked):
            least = np.partition(total, -k)[-k] - 2e-9 if len(total) > k else 0.0
            found = np.flatnonzero((total > 0) & (total >= least))
            out.append((np.full(len(found), i), found, total[found]))
        i, found, total = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([asked[key].take(pa.array(i)), docs["id"].take(pa.array(found)), pa.array(total)], schema=kinds)

    return best


GRAM = 8  # characters by which a phrase is looked up


def _holding(texts: list[str], phrases: list[list[str]]) -> dict[int, list[int]]:
    """Of each list of phrases that has one, the texts that hold one of its phrases. A text is looked through once for the first
    characters of all phrases."""
    first: dict[str, dict[str, list[int]]] = {}
    for i, some in enumerate(phrases):
        for p in some:
            first.setdefault(p[:GRAM], {}).setdefault(p, []).append(i)
    sizes, out = sorted({len(f) for f in first}), {}
    for d, text in enumerate(texts):
        met = {g for n in sizes for at in range(len(text) - n + 1) if (g := text[at : at + n]) in first}
        for i in {i for g in met for p, who in first[g].items() if p in text for i in who}:
            out.setdefault(i, []).append(d)
    return out


def _block_gold(key: str):
    """(key, id, score), rounded, of a block's documents (text in lower case) that hold a phrase of a question (phrases) and share a term with it."""

    def gold(docs: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([asked.schema.field(key), docs.schema.field("id"), pa.field("score", pa.float64())])
        held = _holding(docs["text"].to_pylist(), asked["phrases"].to_pylist()) if docs.num_rows and asked.num_rows else {}
        if not held:
            return kinds.empty_table()
        who = sorted(held)
        out = []
        for i, total in _scores(docs, asked.take(pa.array(who))):
            found = np.array([d for d in held[who[i]] if total[d] > 0], dtype=np.int64)
            out.append((np.full(len(found), who[i]), found, np.round(total[found], 9)))
        i, found, total = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([asked[key].take(pa.array(i)), docs["id"].take(pa.array(found)), pa.array(total)], schema=kinds)

    return gold


def _block_ahead(key: str):
    """(key, ahead): of each question how many of a block's documents rank before the one given with it (id, score)."""

    def ahead(docs: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([asked.schema.field(key), pa.field("ahead", pa.int64())])
        if not docs.num_rows or not asked.num_rows:
            return kinds.empty_table()
        n, limit, ids = [], asked["score"].to_numpy(), docs["id"].combine_chunks()
        for i, total in _scores(docs, asked):
            total = np.round(total, 9)
            level = np.flatnonzero(total == limit[i])
            n.append(int((total > limit[i]).sum()) + (pc.sum(pc.less(ids.take(pa.array(level)), asked["id"][i])).as_py() or 0))
        return pa.Table.from_arrays([asked[key].combine_chunks(), pa.array(n, pa.int64())], schema=kinds)

    return ahead


def _asked(docs: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(key, words, idf, avgdl) of the questions that share a term with the documents (id, dl, terms)."""
    terms = query_terms(questions, key)
    df = docs.select(F.explode(F.array_distinct("terms")).alias("term")).where(may_be_in(F.col("term"), terms, "term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    each = terms.hint("merge").join(df, "term").crossJoin(F.broadcast(stats)).select(key, "term", idf.alias("idf"), "avgdl")  # one row
    asked = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("x"), F.first("avgdl").alias("avgdl"))
    return stored(asked.select(key, F.transform("x", lambda x: x["term"]).alias("words"), F.transform("x", lambda x: x["idf"]).alias("idf"), "avgdl"), "bm25-asked")


def _per_block(docs: DataFrame, asked: DataFrame, work, kinds: T.StructType) -> DataFrame:
    """What work gives of each block of documents and all questions."""
    blocks = max(1, -(-docs.count() // BLOCK))
    every = asked.crossJoin(F.broadcast(docs.sparkSession.range(blocks).select(F.col("id").alias("block"))))  # a number per block
    placed = docs.withColumn("terms", F.array_join("terms", " ")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))  # a text is shuffled smaller than a list
    return placed.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(work, kinds)


def gold_ranks(documents: DataFrame, questions: DataFrame, phrases: DataFrame, key: str = "qid") -> DataFrame:
    """(key, id, rank): of each question the document that ranks first among those that hold one of its phrases (phrases has
    key and phrase, whatever the case), with its rank among all documents that share a term with the question.

    Documents before it are counted by blocks; neither the ranking nor the scores are rows.
    """
    index = texts(documents).documents
    some = phrases.where("phrase is not null").groupBy(key).agg(F.collect_set(F.lower("phrase")).alias("phrases"))
    asked = stored(_asked(index, questions, key).join(some, key), "bm25-phrases")
    docs = index.join(documents.select("id", F.lower("text").alias("text")), "id")
    scored = T.StructType([asked.schema[key], index.schema["id"], T.StructField("score", T.DoubleType())])
    found = _per_block(docs, asked, _block_gold(key), scored)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    best = stored(found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r"), "bm25-gold")
    counted = T.StructType([asked.schema[key], T.StructField("ahead", T.LongType())])
    before = _per_block(index, asked.drop("phrases").join(best, key), _block_ahead(key), counted).groupBy(key).agg(F.sum("ahead").alias("ahead"))
    return best.join(before, key).select(key, "id", (F.col("ahead") + 1).alias("rank"))


def _ranked_texts(index: Texts, questions: DataFrame, k: int, min_score: float, key: str) -> DataFrame:
    """ranking over blocks of documents: a block takes all questions at once and gives its k best for each, so neither postings nor
    the scores of all pairs are ever rows."""
    docs = index.documents
    asked = _asked(docs, questions, key)
    kinds = T.StructType([asked.schema[key], docs.schema["id"], T.StructField("score", T.DoubleType())])
    found = _per_block(docs.select("id", "dl", "terms"), asked, _block_best(k, key), kinds).where(F.col("score") >= min_score)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "id")
    top = stored(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "bm25-top")
    shared = top.join(docs.select("id", "terms"), "id").join(asked.select(key, "words"), key)
    return shared.select(key, "rank", "id", "score", F.array_intersect("words", "terms").alias("matched_terms"))


def query_terms(questions: DataFrame, key: str = "qid", question: str = "question") -> DataFrame:
    """(key, term): distinct terms of each question without stop words."""
    return questions.select(key, F.explode(F.array_distinct(drop_stop_words(zh_terms(F.col(question))))).alias("term"))


def score(index: Index, terms: DataFrame, key: str = "qid") -> DataFrame:
    """(key, id, score, matched) of every document that shares a term."""
    hit = terms.join(index.postings.select("term", "id", "weight"), "term")
    return hit.groupBy(key, "id").agg(F.sum("weight").alias("score"), F.sort_array(F.collect_set("term")).alias("matched_terms"))


def ranking(index: Index | Texts, questions: DataFrame, k: int = TOP, min_score: float = MIN_SCORE, key: str = "qid") -> DataFrame:
    """(key, rank, id, score, matched_terms): of each question the k best documents that reach min_score, by score and then
    id; scores as they are."""
    if isinstance(index, Texts):
        return _ranked_texts(index, questions, k, min_score, key)
    s = score(index, query_terms(questions, key), key).where(F.col("score") >= min_score)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "id", "score", "matched_terms")


def topic_recall(index: Index | Texts, questions: DataFrame, k: int = TOP, min_score: float = MIN_SCORE, key: str = "qid") -> DataFrame:
    """(key, rank, id, score, matched_terms): of each question the k best documents that reach min_score before
    rounding, by score and then id; scores to 4 places."""
    return ranking(index, questions, k, min_score, key).withColumn("score", F.round("score", 4))


HEADING = "【BM25 Top-8 文档】（来源: 纯 BM25 检索，无图谱结构 / 无符号链接 / 无影响面）"


def bm25_context(index: Index | Texts, questions: DataFrame, documents: DataFrame, key: str = "qid", budget: int = BUDGET) -> DataFrame:
    """The baseline: (key, linked, context_text), of every question the ids of the 8 best documents of any score, and their
    whole texts in this order within the budget. A text that doesn't fit ends the context.

    documents has id and text, and may have label, name and path.
    """
    has = lambda c, other: F.coalesce(F.col(c), other) if c in documents.columns else other
    place = F.when(has("path", F.lit("")) != "", F.concat(F.lit("  ⟨"), has("path", F.lit("")), F.lit("⟩"))).otherwise("")
    shown = documents.select("id", F.concat(F.lit("] ["), has("label", F.lit("Document")), F.lit("] "), has("name", F.col("id").cast("string")), place).alias("head"), F.coalesce("text", F.lit("")).alias("text"))
    top = stored(topic_recall(index, questions, TOP, 0.0, key), "bm25-context")
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.col("head"), F.lit("  (BM25="), F.col("score").cast("string"), F.lit(")"))
    lines = top.join(shown, "id").select(key, F.col("rank").cast("int").alias("o"), F.posexplode(F.array(head, F.concat(F.lit("    "), "text"))).alias("p", "line"))
    every = questions.select(key).distinct()
    lines = every.select(key, F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit(HEADING).alias("line")).unionByName(lines).select(key, F.struct("o", "p").alias("seq"), "line")
    linked = top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("linked"))
    return within_budget(lines, key, budget).join(linked, key, "left").select(key, "linked", "context_text")
