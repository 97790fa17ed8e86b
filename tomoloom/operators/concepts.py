"""Concept extraction and matching over word boxes `(doc_id, page_no, word_no, x0, y0, x1, y1, word)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomoloom.functions.skew import bucketed_row_number, hot_keys, salted_join
from tomoloom.functions.storage import materialize
from tomoloom.functions.text import clean_word, is_concept_token, is_stopword, tokens

# Two words of four letters or more match when one starts with the other, so matching words always share this prefix.
PREFIX = 4
PAGES_PER_BUCKET = 65_536
# Fewest prompt hits a document needs, size of the list that replaces the prompt, shortest auto term.
MIN_HITS, AUTO_TERMS, AUTO_LENGTH = 8, 14, 5


def prompt_concepts(prompts: DataFrame, set_id: str = "set_id", text: str = "value") -> DataFrame:
    """Content words of each prompt, each once: `(set_id, concept, ord)`; sorting by `ord` gives reading order."""
    words = prompts.select(set_id, F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    kept = words.filter(is_concept_token(F.col("token")))
    return kept.groupBy(set_id, F.lower("token").alias("concept")).agg(F.min("pos").alias("ord"))


def auto_concepts(boxes: DataFrame, top_n: int = AUTO_TERMS) -> DataFrame:
    """Each document's most frequent long words: `(doc_id, concept, n, ord)`, ties by first appearance."""
    terms = (
        boxes.select(
            "doc_id", "page_no", "word_no", F.posexplode(tokens(F.col("word"))).alias("_i", "_token")
        )
        .withColumn("concept", F.lower("_token"))
        .filter((F.length("concept") >= AUTO_LENGTH) & ~is_stopword(F.col("concept")))
    )
    counted = terms.groupBy("doc_id", "concept").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page_no", "word_no", "_i")).alias("_first")
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), F.asc("_first")))
    return (
        counted.withColumn("_rank", rank)
        .filter(F.col("_rank") <= top_n)
        .select("doc_id", "concept", "n", (F.col("_rank") - 1).alias("ord"))
    )


def _prefix(word: Column) -> Column:
    return F.substring(word, 1, PREFIX)


def _by_prefix(concepts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Concepts that could match the same word, as one list in matching order."""
    entry = F.struct("ord", "concept")
    return concepts.groupBy(*keys, _prefix(F.col("concept")).alias("_prefix")).agg(
        F.sort_array(F.collect_list(entry)).alias("_candidates")
    )


def _first_match(word: Column, candidates: Column) -> Column:
    """First candidate equal to the word, or, both long enough, in a prefix relation with it; else null."""

    def fits(candidate: Column) -> Column:
        concept = candidate["concept"]
        long_enough = (F.length(word) >= PREFIX) & (F.length(concept) >= PREFIX)
        return (word == concept) | (long_enough & (word.startswith(concept) | concept.startswith(word)))

    return F.get(F.filter(candidates, fits), F.lit(0))["concept"]


def with_clean_words(boxes: DataFrame) -> DataFrame:
    """Add the cleaned word; a word with nothing left of it can never match."""
    cleaned = boxes.withColumn("clean", clean_word(F.col("word")))
    return cleaned.withColumn("_prefix", _prefix(F.col("clean")))


Concepts = Sequence[str] | DataFrame


def concept_table(boxes: DataFrame, concepts: Concepts) -> DataFrame:
    """`(ord, concept)` of a list, or of a table that has them."""
    if isinstance(concepts, DataFrame):
        return concepts.select("ord", "concept")
    return boxes.sparkSession.createDataFrame(list(enumerate(concepts)), "ord int, concept string")


def _match_list(boxes: DataFrame, concepts: Concepts, how: str) -> DataFrame:
    listed = concept_table(boxes, concepts).filter(F.col("concept") != "")
    # Written first: the table's true size decides whether it is broadcast or both sides are shuffled.
    by_prefix = materialize(_by_prefix(listed, []))
    matched = with_clean_words(boxes).join(by_prefix, "_prefix", how)
    return matched.withColumn("concept", _first_match(F.col("clean"), F.col("_candidates"))).drop(
        "_candidates", "_prefix"
    )


def match_prompt(boxes: DataFrame, concepts: Concepts) -> DataFrame:
    """Add `concept`, the first of the list that matches the word, null where none does.

    A list small enough to be broadcast leaves the boxes where they are.
    """
    return _match_list(boxes, concepts, "left")


def prompt_hits(boxes: DataFrame, concepts: Concepts) -> DataFrame:
    """Word boxes that match a prompt concept; words without a candidate are dropped by the join itself."""
    return _match_list(boxes, concepts, "inner").filter(F.col("concept").isNotNull())


def first_pages(boxes: DataFrame, max_pages: int | None) -> DataFrame:
    return boxes if max_pages is None else boxes.filter(F.col("page_no") <= max_pages)


def document_hits(matched: DataFrame, min_hits: int = MIN_HITS, max_pages: int | None = None) -> DataFrame:
    """Prompt hits per document, and whether they are too few; documents without any hit are included.

    Hits count on the first `max_pages` pages, words everywhere, so a document with empty first pages is there too.
    """
    found = F.col("concept") if max_pages is None else F.when(F.col("page_no") <= max_pages, F.col("concept"))
    return matched.groupBy("doc_id").agg(
        F.count(found).alias("n_hits"),
        F.count_if(F.col("clean") != "").alias("n_words"),
        (F.count(found) < min_hits).alias("fallback"),
    )


def match_auto(
    boxes: DataFrame, concepts: DataFrame, documents: DataFrame, rows_per_task: int = 1_000_000
) -> DataFrame:
    """Word boxes that match their own document's concept list.

    Joined on the document alone, so boxes that are dealt by document already are not moved. A document with more than
    `rows_per_task` words (`documents.n_words`) is joined on word prefixes too and spread further by word position.
    """
    hot = hot_keys(documents, ["doc_id"], "n_words", rows_per_task)
    cleaned, large = with_clean_words(boxes), hot.select("doc_id")
    by_prefix = F.map_from_entries(F.collect_list(F.struct("_prefix", "_candidates")))
    # A few words for each document: hashed, so that the boxes need not be sorted.
    lists = _by_prefix(concepts, ["doc_id"]).groupBy("doc_id").agg(by_prefix.alias("_lists")).hint("shuffle_hash")

    def with_candidates(words: DataFrame) -> DataFrame:
        joined = words.join(lists, "doc_id").withColumn("_candidates", F.try_element_at("_lists", F.col("_prefix")))
        return joined.filter(F.col("_candidates").isNotNull()).drop("_lists")

    if hot.isEmpty():
        matched = with_candidates(cleaned)
    else:
        spread = salted_join(
            cleaned.join(large, "doc_id", "left_semi"),
            _by_prefix(concepts.join(large, "doc_id", "left_semi"), ["doc_id"]),
            ["doc_id", "_prefix"],
            hot,
            spread=["page_no", "word_no"],
            hot_on=["doc_id"],
        )
        matched = with_candidates(cleaned.join(large, "doc_id", "left_anti")).unionByName(spread)
    return (
        matched.withColumn("concept", _first_match(F.col("clean"), F.col("_candidates")))
        .filter(F.col("concept").isNotNull())
        .drop("_candidates", "_prefix")
    )


def resolve_documents(
    boxes: DataFrame, concepts: Concepts, min_hits: int = MIN_HITS, max_pages: int | None = None
) -> DataFrame:
    """`document_hits` of the searched pages, written once."""
    return materialize(document_hits(match_prompt(boxes, concepts), min_hits, max_pages))


def set_aside(boxes: DataFrame, documents: DataFrame) -> DataFrame:
    """Words of the documents that fall back, usually few, written once."""
    return materialize(boxes.join(documents.filter("fallback").select("doc_id"), "doc_id", "left_semi"))


def resolved_hits(
    boxes: DataFrame,
    concepts: Concepts,
    min_hits: int = MIN_HITS,
    top_n: int = AUTO_TERMS,
    max_pages: int | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Hits for the prompt, or, in documents where it has fewer than `min_hits`, for their own frequent words.

    `max_pages` limits where hits are looked for; frequent words always come from the whole document.
    Adds `fallback`. Pass `documents` if `resolve_documents` has run already.
    """
    if documents is None:
        # The hits, far fewer than the words, say which documents have enough; no second search.
        found = materialize(prompt_hits(first_pages(boxes, max_pages), concepts))
        counted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))
        rich = materialize(counted.filter(F.col("n_hits") >= min_hits).select("doc_id"))
        kept = found.join(rich, "doc_id", "left_semi")
        poor = materialize(boxes.join(rich, "doc_id", "left_anti"))
    else:
        kept = prompt_hits(first_pages(boxes, max_pages), concepts)
        kept = kept.join(documents.filter("fallback").select("doc_id"), "doc_id", "left_anti")
        poor = set_aside(boxes, documents)
    redone = auto_hits(poor, top_n, max_pages)
    return kept.withColumn("fallback", F.lit(False)).unionByName(redone.withColumn("fallback", F.lit(True)))


def concepts_used(
    boxes: DataFrame, concepts: Concepts, documents: DataFrame, top_n: int = AUTO_TERMS
) -> DataFrame:
    """Per document whether it fell back and the list it was searched for, in matching order."""
    own = (
        auto_concepts(set_aside(boxes, documents), top_n)
        .groupBy("doc_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "concept"))), lambda e: e["concept"]).alias("own"))
    )
    listed = concept_table(boxes, concepts)
    prompt = listed.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "concept"))), lambda e: e["concept"]).alias("prompt"))
    # One row, for the documents that do not fall back: the prompt's list, whatever its length.
    one = materialize(prompt.withColumn("fallback", F.lit(False)))
    with_prompt = documents.join(one, "fallback", "left")
    used = F.when(F.col("fallback"), F.coalesce("own", F.array().cast("array<string>"))).otherwise(F.col("prompt"))
    return with_prompt.join(own, "doc_id", "left").select("doc_id", "fallback", used.alias("concepts"))


def auto_hits(boxes: DataFrame, top_n: int = AUTO_TERMS, max_pages: int | None = None) -> DataFrame:
    """Hits for every document's own frequent words, without trying a prompt first."""
    sizes = materialize(boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words")))
    own = materialize(auto_concepts(boxes, top_n))
    return match_auto(first_pages(boxes, max_pages), own.select("doc_id", "concept", "ord"), sizes)


def page_hits(hits: DataFrame) -> DataFrame:
    """Hits per page; pages without a hit are absent."""
    return hits.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_hits"))


def rank_pages(pages: DataFrame) -> DataFrame:
    """Add `rank`, a page's place in its document by hits (then page number); tasks stay bounded for any document.

    `pages` is read twice: pass a written table.
    """
    bucketed = pages.withColumn("_block", F.floor(F.col("page_no") / PAGES_PER_BUCKET))
    ranked = bucketed_row_number(
        bucketed,
        ["doc_id"],
        [("n_hits", True), ("_block", False)],
        [F.asc("page_no")],
        "rank",
    )
    return ranked.drop("_block")


def strongest_page(pages: DataFrame) -> DataFrame:
    """The page with most hits in each document, the earliest on ties."""
    best = F.max(F.struct("n_hits", (-F.col("page_no")).alias("p")))
    return pages.groupBy("doc_id").agg(best.alias("b")).select(
        "doc_id", (-F.col("b.p")).alias("page_no"), F.col("b.n_hits").alias("n_hits")
    )


def top_pages(pages: DataFrame, n: int = 10, document_order: str = "doc_id") -> DataFrame:
    """The `n` pages with most hits over all documents."""
    return pages.orderBy(F.desc("n_hits"), document_order, "page_no").limit(n)


def top_pages_per_document(pages: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_hits"), "page_no"))
    return pages.withColumn("rank", rank).filter(F.col("rank") <= n)


def heat_file_name(page_no: Column) -> Column:
    return F.format_string("page_%02d_heatmap.png", page_no)
