import random
import re

import pytest
from pyspark.sql import functions as F

from tomoloom.functions.text import STOPWORDS, clean_word, file_extension, is_sealed_blob, slug, strip
from tomoloom.operators import concepts
from tomoloom.plans import derived
from tomoloom.plans.reports import literature_manifest
from tomoloom.schemas import WORD_BOX


def boxes(spark, documents):
    """`documents`: {doc_id: [[words of page 1], [words of page 2], …]}"""
    rows = []
    for doc, pages in documents.items():
        n = 0
        for page_no, words in enumerate(pages, start=1):
            for word in words:
                rows.append((doc, page_no, n, 10.0 * n, 5.0, 10.0 * n + 8, 15.0, word))
                n += 1
    return spark.createDataFrame(rows, WORD_BOX)


def one(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], list(columns))
    return frame.select(expression.alias("r")).first()["r"]


def first_match(word, wanted):
    """The matching rule stated once more, word by word."""
    for concept in wanted:
        short, long = sorted((word, concept), key=len)
        if word == concept or (len(short) >= 4 and long[: len(short)] == short):
            return concept
    return None


def test_prompt_gives_its_concepts_in_order(spark):
    # A prompt and the concepts it must give.
    prompt = (
        "Look for literature that uses segmentation methods on octet struts in CT scan images, and tell me what "
        "segmentation maps or threshold-determination approaches they use. Give me a literature review of all the "
        "methods others have used in this domain."
    )
    expected = "literature segmentation methods octet struts ct scan images maps threshold determination approaches review domain"
    frame = spark.createDataFrame([("p", prompt)], "set_id string, value string")
    found = concepts.prompt_concepts(frame).orderBy("ord").collect()
    assert [r.concept for r in found] == expected.split()


def test_short_words_count_only_as_acronyms_and_never_as_stopwords(spark):
    frame = spark.createDataFrame([("p", "AI ai IT US X ct-Ab CNC éa fab")], "set_id string, value string")
    found = [r.concept for r in concepts.prompt_concepts(frame).orderBy("ord").collect()]
    assert found == ["ai", "cnc", "fab"]


def test_matching_rule_on_random_words(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("ab-") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    wanted = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randint(2, 6))) for _ in range(25)))
    page = boxes(spark, {1: [vocabulary]})
    found = {(r.word_no, r.concept) for r in concepts.prompt_hits(page, wanted).collect()}
    assert found == {(i, m) for i, w in enumerate(vocabulary) if (m := first_match(w, wanted))}


def test_earlier_prefix_beats_later_exact_match(spark):
    page = boxes(spark, {1: [["ther", "therefore", "the", "Then"]]})
    found = concepts.prompt_hits(page, ["therea", "ther", "the"]).orderBy("word_no").collect()
    assert [(r.word, r.concept) for r in found] == [("ther", "therea"), ("therefore", "ther"), ("the", "the")]


def test_word_cleaning(spark):
    for word, expected in {"(Über-lattice),": "ber-lattice", "3D": "d", "42": "", "x-ray": "x-ray"}.items():
        assert one(spark, clean_word(F.col("w")), w=word) == expected


def test_auto_concepts_by_count_then_first_appearance(spark):
    pages = [["strut,", "Strut", "lattice/mesh", "about", "abouts"], ["porous", "strut", "lattice", "zebra", "would"]]
    found = concepts.auto_concepts(boxes(spark, {1: pages}), top_n=3).orderBy("ord").collect()
    assert [(r.concept, r.n) for r in found] == [("strut", 3), ("lattice", 2), ("abouts", 1)]


def fallback_documents():
    rng = random.Random(1)
    words = ["strut", "struts", "ct", "porous", "anneal", "powder", "laser", "fusion", "the", "scan-path"]
    documents = {d: [[rng.choice(words) for _ in range(60)] for _ in range(3)] for d in range(6)}
    documents[9] = [["nothing", "matches", "here", "matches"], ["nothing"]]
    documents[10] = [["strut"] * 7]
    documents[11] = [["strut"] * 8]
    return documents


def expected_hits(documents, wanted, min_hits=8, max_pages=None):
    out = {}
    for doc, pages in documents.items():
        searched = pages[:max_pages]

        def count(concept_list):
            hits = {}
            for page_no, page in enumerate(searched, start=1):
                n = sum(first_match(re.sub("[^A-Za-z-]", "", w).lower(), concept_list) is not None for w in page)
                if n:
                    hits[page_no] = n
            return hits

        hits = count(wanted)
        fallback = sum(hits.values()) < min_hits
        if fallback:
            seen = {}
            for word in (t.lower() for page in pages for w in page for t in re.findall("[A-Za-z]+", w)):
                if len(word) >= 5 and word not in STOPWORDS:
                    seen[word] = seen.get(word, 0) + 1
            hits = count(sorted(seen, key=lambda w: -seen[w])[:14])
        out |= {(doc, page, fallback): n for page, n in hits.items()}
    return out


@pytest.mark.parametrize("max_pages", [None, 1])
@pytest.mark.parametrize("wanted", [["strut", "ct"], ["zzzz"]])
def test_documents_with_too_few_hits_use_their_own_words(spark, wanted, max_pages):
    documents = fallback_documents()
    hits = concepts.resolved_hits(boxes(spark, documents), wanted, max_pages=max_pages)
    counted = hits.groupBy("doc_id", "page_no", "fallback").count().collect()
    assert {tuple(r[:3]): r[3] for r in counted} == expected_hits(documents, wanted, max_pages=max_pages)


def test_a_document_split_over_tasks_gives_the_same_hits(spark):
    page = boxes(spark, fallback_documents())
    sizes = page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))
    own = concepts.auto_concepts(page).select("doc_id", "concept", "ord")

    def run(rows_per_task):
        return sorted(
            (r.doc_id, r.word_no, r.concept) for r in concepts.match_auto(page, own, sizes, rows_per_task).collect()
        )

    assert run(10) == run(1_000_000) != []


def test_page_ranking(spark):
    # Hits per page, in the order the pages must be ranked.
    golden = [(8, 60), (13, 49), (11, 42), (9, 37), (5, 32), (6, 30), (7, 29), (10, 25), (4, 24), (12, 18), (15, 13),
              (3, 11), (14, 10), (16, 3)]
    shuffled = random.Random(0).sample(golden, len(golden))
    pages = spark.createDataFrame([(1, p, n) for p, n in shuffled], "doc_id bigint, page_no int, n_hits bigint")
    manifest = literature_manifest(pages)
    ranked = manifest.filter("section = 'pages'").orderBy("rank").collect()
    assert [(r.page_no, r.n_hits) for r in ranked] == golden
    top = manifest.filter("section = 'strongest'").orderBy("rank").collect()
    assert [(r.page_no, r.n_hits) for r in top] == golden[:10]
    assert top[0].file == "page_08_heatmap.png"
    best = concepts.strongest_page(pages).first()
    assert (best.page_no, best.n_hits) == (8, 60)


def test_ties_keep_page_order(spark):
    pages = spark.createDataFrame(
        [(1, p, 4) for p in (70_000, 3, 65_536, 2)] + [(0, 9, 4)], "doc_id bigint, page_no int, n_hits bigint"
    )
    ranked = concepts.rank_pages(pages).filter("doc_id = 1").orderBy("rank").collect()
    assert [r.page_no for r in ranked] == [2, 3, 65_536, 70_000]
    assert [(r.doc_id, r.page_no) for r in concepts.top_pages(pages, 2).collect()] == [(0, 9), (1, 2)]
    kept = concepts.top_pages_per_document(pages, 3).filter("doc_id = 1").orderBy("rank").collect()
    assert [r.page_no for r in kept] == [2, 3, 65_536]


@pytest.mark.parametrize(
    ("path", "ext", "name"),
    [
        ("a/b/Paper (v2).final.PDF", ".pdf", "Paper__v2__final"),
        ("x/.hidden", "", "hidden"),
        ("x/..a.b", ".b", "a"),
        ("no_suffix", "", "no_suffix"),
        ("dir.d/plain", "", "plain"),
        ("d/__.txt", ".txt", "paper"),
        ("d/" + "a" * 59 + "_b.pdf", ".pdf", "a" * 59 + "_"),
        ("d/naïve-Ünï.md", ".md", "naïve-Ünï"),
        ("d/trailing.", ".", "trailing"),
    ],
)
def test_paths(spark, path, ext, name):
    assert one(spark, file_extension(F.col("p")), p=path) == ext
    assert one(spark, slug(F.col("p")), p=path) == name


def test_strip_and_blobs(spark):
    assert one(spark, strip(F.col("t")), t=" \t\n \x1fa b\x0b \r\n") == "a b"
    cases = {
        "gAAAAAx": True,
        "A" * 121: True,
        "A" * 120: False,
        "A" * 120 + " ": False,
        "A" * 133 + "+" * 7: False,
        "A" * 134 + "/" * 7: True,
    }
    for text, expected in cases.items():
        assert one(spark, is_sealed_blob(F.col("t")), t=text) is expected, text


def test_very_long_concept_lists(spark):
    concepts_ = spark.range(150_000).selectExpr("cast(id as int) as ord", "concat('w', lpad(lower(conv(id, 10, 16)), 6, '0')) as concept")
    letters = concepts_.select("ord", F.translate("concept", "0123456789", "ghijklmnop").alias("concept"))
    wanted = [r.concept for r in letters.filter("ord % 50000 = 7").orderBy("ord").collect()]
    found = concepts.prompt_hits(boxes(spark, {1: [[*wanted, "zzzz"]]}), letters)
    assert [r.concept for r in found.orderBy("word_no").collect()] == wanted


def test_documents_with_empty_first_pages_stay(spark):
    pages = boxes(spark, {1: [["zzzz"], ["strut"] * 9], 2: [["strut"] * 9]})
    later = pages.filter("doc_id = 2 or page_no > 1")
    found = {r.doc_id: (r.n_hits, r.fallback) for r in concepts.resolve_documents(later, ["strut"], max_pages=1).collect()}
    assert found == {1: (0, True), 2: (9, False)}


def test_words_dealt_by_document_are_not_moved(spark, tmp_path):
    texts = spark.range(40).selectExpr("id as doc_id", "repeat('lattice strut porous ', 20) as text")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    page = derived.word_boxes(spark, str(tmp_path))
    sizes = page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))
    own = concepts.auto_concepts(page)
    for frame in (concepts.match_auto(page, own.select("doc_id", "concept", "ord"), sizes), own):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.split("Initial Plan")[0].split("\n") if "Exchange" in line]
        assert dealt and all("REPARTITION_BY" in line or "Reused" in line for line in dealt), dealt


def test_large_and_small_documents_match_alike(spark):
    documents = fallback_documents()
    page = boxes(spark, documents)
    sizes = page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))
    own = concepts.auto_concepts(page).select("doc_id", "concept", "ord")
    found = [
        {tuple(r) for r in concepts.match_auto(page, own, sizes, n).select("doc_id", "page_no", "word_no", "concept").collect()}
        for n in (1, 100, 1_000_000)
    ]
    assert found[0] and found[0] == found[1] == found[2]
