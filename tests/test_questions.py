from __future__ import annotations

import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import plan_of
from veilscan.functions.text import STOP_WORDS
from veilscan.operators.corpus_search import best_in_block, build_sentence_index, corpus_sentences
from veilscan.operators.questions import answer_questions, answers_with_fallback, relevant_sentences, route_by_words
from veilscan.operators.retrieval import chunk_text, nearest_chunks, pack_text, question_context, question_requests, scored_chunks
from veilscan.plans.analysis import analyze, succeeded, with_playbook
from veilscan.settings import Options

ROUTES = [
    ("What compliance risks are present?", "risk"),
    ("Is there any sensitive data risk?", "risk"),
    ("Which company is named?", "findings"),
    ("What is this about?", "summary"),
    ("How do I fix it?", "remediation"),
    ("xyzzy quux?", None),
]


def test_golden_routes(spark):
    rows = spark.createDataFrame(ROUTES, "question string, want string")
    assert all(r.want == r.got for r in rows.withColumn("got", route_by_words(F.col("question"))).collect())


def test_answers(spark):
    docs = spark.createDataFrame([(1, "Call 9876543210. The Moon is far!\nMail bob@x.co now"), (2, " ")], "doc_id long, text string")
    results = with_playbook(succeeded(analyze(docs)))
    asked = [
        (1, 1, "Any risk?"), (2, 1, "Which email?"), (3, 1, "overview"), (4, 1, "next step"), (5, 1, "moon far"),
        (6, 1, "zzz"), (7, 1, "  "), (8, 2, "Any risk?"), (9, 99, "Any risk?"),
    ]
    questions = spark.createDataFrame(asked, "q_id long, doc_id long, question string")
    got = {r.q_id: r for r in answer_questions(questions, results).collect()}
    routes = ["risk", "findings", "summary", "remediation", "sentences", "default", "blank", "no_document", "no_document"]
    assert [got[i + 1].route for i in range(9)] == routes
    assert got[5].answer == "Relevant document context:\n- The Moon is far!"
    assert got[5].sources == ["The Moon is far!"]
    assert got[2].answer.startswith("I found 2 sensitive item(s) in the document.\n\nDetection counts:\n- Email: 1\n- Phone: 1\n\n")
    assert "Masked excerpt: Call XXXXXX3210. The Moon is far! Mail bo****@x.co now" in got[3].answer
    assert got[1].sources == ["Call XXXXXX3210. The Moon is far!\nMail bo****@x.co now"]
    assert got[7].sources == got[9].sources == []


def test_chunks_rebuild_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = spark.createDataFrame([(-1, "éab" * 50000), (-2, "  "), (-3, "x" * 1000), (-4, "x" * 1001)], "doc_id long, text string")
    corpus = docs.unionByName(long)
    texts = {r.doc_id: r.text for r in corpus.collect()}
    seen: dict[int, dict[int, str]] = {}
    for r in chunk_text(corpus).collect():
        assert r.start == 850 * r.chunk_no and len(r.chunk) <= 1000
        seen.setdefault(r.doc_id, {})[r.chunk_no] = r.chunk
    assert -2 not in seen and len(seen[-3]) == 1 and len(seen[-4]) == 2
    for doc_id, parts in seen.items():
        ordered = [parts[i] for i in range(len(parts))]
        assert ordered[0] + "".join(p[150:] for p in ordered[1:]) == texts[doc_id]


def test_packed_chunks_rebuild_the_text_and_cut_no_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [
        (-1, "éab" * 5000), (-2, "  "), (-3, "x" * 1000), (-4, "x" * 1001), (-5, None), (-7, " " * 3000 + "x"),
        (-6, "\n\n\n a b.  c\n\n" + "word " * 3000 + "\n\n" + "Sentence one. " * 400),
    ]
    corpus = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts, found = {r.doc_id: r.text for r in corpus.collect()}, {}
    for r in pack_text(corpus).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(texts) - set(found) == {-2, -5}
    for doc_id, chunks in found.items():
        text, end = texts[doc_id], 0
        for c in sorted(chunks, key=lambda c: c.chunk_no):
            assert 0 < len(c.chunk) <= 1000 and text[c.start : c.start + len(c.chunk)] == c.chunk
            assert end - c.start <= 150 and not text[end : max(end, c.start)].strip()
            # words longer than a chunk are cut, no others
            assert c.start == 0 or text[c.start - 1].isspace() or doc_id in (-1, -4)
            end = c.start + len(c.chunk)
        assert not text[end:].strip()


def test_packed_chunks_prefer_paragraphs_and_carry_their_end(spark):
    text = "\n\n".join(f"Paragraph {k}. " + "x" * 20 for k in range(6))
    options = Options(chunk_size=90, chunk_overlap=40)
    got = [r.chunk for r in pack_text(spark.createDataFrame([(1, text)], "doc_id long, text string"), options=options).orderBy("chunk_no").collect()]
    parts = [p + "\n\n" for p in text.split("\n\n")]
    parts[-1] = parts[-1][:-2]
    assert got == ["".join(parts[0:2]), "".join(parts[1:3]), "".join(parts[2:4]), "".join(parts[3:5]), "".join(parts[4:6])]


def test_hot_document_is_spread_over_tasks(spark):
    chunks = spark.range(512).selectExpr("7L as doc_id", "id as chunk_no", "array(cast(id as float), 1f) as vector")
    questions = spark.createDataFrame([(1, 7, [100.2, 1.0]), (2, 7, [-3.0, 0.0])], "q_id long, doc_id long, q_vector array<double>")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        tasks = scored_chunks(questions, chunks, range_chunks=32).select(F.spark_partition_id()).distinct().count()
        assert tasks > 2  # of one document
        rows = [{(r.q_id, r.rank, r.chunk_no) for r in nearest_chunks(questions, chunks, range_chunks=n).collect()} for n in (32, 4096)]
        assert rows[0] == rows[1] and {(1, 1, 100), (1, 2, 101), (2, 1, 0), (2, 4, 3)} <= rows[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_corpus_search_equals_the_substring_rule(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "Alpha@x.co met B-52.\nalphabet soup! ALPHA"), (-2, None), (-3, " \n"), (-4, "no hit")], "doc_id long, text string")
    corpus = docs.unionByName(odd)
    asked = [(1, "Tell me about alpha@x.co and b-52"), (2, "the of"), (3, ""), (4, "pha zzzqqq"), (5, "Étion dans ment können ung"), (6, "ion ion")]
    questions = spark.createDataFrame(asked, "q_id long, question string")
    index = build_sentence_index(corpus, str(tmp_path / "index"), text="text")
    got = sorted((r.q_id, r.rank, r.score, r.doc_id, r.sentence) for r in corpus_sentences(questions, index).collect())
    want = []
    for q, question in asked:
        terms = {t for t in re.findall("[A-Za-z0-9_@.-]+", question.lower()) if len(t) > 2 and t not in STOP_WORDS}
        hits = []
        for r in corpus.collect():
            for pos, raw in enumerate(re.split(r"(?<=[.!?])\s+|\n+", r.text or "")):
                flat = " ".join(raw.split())
                if score := sum(t in flat.lower() for t in terms):
                    hits.append((-score, r.doc_id, pos, flat[:600]))
        want += [(q, k + 1, -s, d, t) for k, (s, d, _, t) in enumerate(sorted(hits)[:4])]
    assert got == sorted(want)
    plan = plan_of(corpus_sentences(questions, index))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_model_answers_count_before_the_fallback(spark):
    docs = spark.createDataFrame([(1, "Mail bob@x.co now")], "doc_id long, text string")
    results = with_playbook(succeeded(analyze(docs)))
    questions = spark.createDataFrame([(1, 1, "Any risk?"), (2, 1, "Any risk?"), (3, 1, " "), (4, 9, "Any risk?"), (5, 1, "x?")], "q_id long, doc_id long, question string")
    model = [(1, "From chunks.", ["a", "b"]), (2, None, ["a"]), (3, "not asked", []), (5, " ", [])]
    retrieved = spark.createDataFrame(model, "q_id long, answer string, sources array<string>")
    got = {r.q_id: r for r in answers_with_fallback(questions, retrieved, results).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].provenance, got[1].answer, got[1].sources) == ("retrieval", "From chunks.", ["a", "b"])
    assert [(got[q].provenance, got[q].route) for q in (2, 3, 4, 5)] == [("fallback", r) for r in ("risk", "blank", "no_document", "default")]


def test_nearest_chunks_keep_k_per_task_before_the_shuffle(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_no"), F.col("embedding").alias("vector")
    )
    questions = vectors.groupBy("doc_id").agg(F.min_by("vector", "chunk_no").alias("q_vector")).withColumn("q_id", F.col("doc_id"))
    near = nearest_chunks(questions, vectors)
    plan = plan_of(near)
    assert "WindowGroupLimit" in plan
    rows = vectors.collect()
    for q in questions.collect():
        dist = sorted(
            (sum((a - b) ** 2 for a, b in zip(r.vector, q.q_vector)), r.chunk_no) for r in rows if r.doc_id == q.doc_id
        )
        got = [r.chunk_no for r in near.where(F.col("q_id") == q.q_id).orderBy("rank").collect()]
        assert got == [c for _, c in dist[:4]] and dist[0][0] == 0


def test_context_and_request(spark):
    chunks = spark.createDataFrame(
        [(1, 0, "alpha", [0.0, 0.0]), (1, 1, "beta", [1.0, 0.0]), (1, 2, "gamma", [5.0, 0.0]), (2, 0, "delta", [0.0, 0.0])],
        "doc_id long, chunk_no int, chunk string, vector array<float>",
    )
    questions = spark.createDataFrame([(7, 1, [1.0, 0.0], " why? ")], "q_id long, doc_id long, q_vector array<float>, question string")
    near = nearest_chunks(questions.drop("question"), chunks.drop("chunk"), k=2)
    context = question_context(near, chunks)
    row = context.first()
    assert row.context == "beta\n\nalpha" and row.sources == ["beta", "alpha"]
    assert question_requests(context, questions).first().prompt.endswith("Passages:\nbeta\n\nalpha\n\nQuestion:\nwhy?")


def test_questions_meet_blocks_of_sentences(spark, tmp_path):
    """Common and rare terms over several blocks of both sides, keys and questions that come twice or are null."""
    rng = random.Random(5)
    common, rare = ["tion", "ment", "thing", "alpha"], [f"w{i:03d}x" for i in range(400)]
    texts = [" ".join(rng.choices(common, k=3) + rng.choices(rare, k=3)) + "." for _ in range(1500)]
    rows = [(None if i % 97 == 0 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(None if q % 50 == 0 else q // 2, " ".join(rng.sample(common, 3) + rng.choices(rare, k=5) + [f"{i}x" for i in range(10 + q % 2)])) for q in range(200)]
    asked.append((900, " ".join(rare) + " thi"))
    questions = spark.createDataFrame(asked, "q_id long, question string")
    index = build_sentence_index(docs, str(tmp_path / "index"), text="text", block=200)
    best = corpus_sentences(questions, index, asked_block=60)
    plan = plan_of(best)
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan
    terms, words, sentences = defaultdict(list), defaultdict(set), defaultdict(list)
    for q, question in asked:
        terms[q] += {t for t in question.split() if len(t) > 2}
    for key, text in rows:
        words[key].add(text)
        sentences[key].append(text)
    want = []
    for q, own in terms.items():
        score = {k: sum(any(t in text for text in found) for t in own) for k, found in words.items()}
        ranked = sorted((-n, k is not None, k or 0) for k, n in score.items() if n)[:4]
        want += [(q, i + 1, -n, k, text) for i, (n, known, k) in enumerate(ranked) if known for text in sentences[k]]
    got = [(r.q_id, r["rank"], r.score, r.doc_id, r.sentence) for r in best.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_sentence_index_is_smaller_than_its_texts(spark, tmp_path):
    """Sentences are stored once, and nothing besides; questions move no more than sentences, questions and winners."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(5000)]
    rows = [(i, " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(20))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = build_sentence_index(docs, str(tmp_path / "index"), text="text", block=5000)
    assert sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet")) < sum(len(t) for _, t in rows)
    best = corpus_sentences(spark.createDataFrame([(1, words[0])], "q_id long, question string"), index)
    assert plan_of(best).count("FileScan parquet") == 1 and "Join" not in plan_of(best)


def test_parts_of_a_block_keep_the_best_of_all():
    """Several parts, places with several texts, long and equal terms, letters whose lower case is no ASCII."""
    rng = random.Random(3)
    common, rare = ["tion", "ment", "thing", "alpha"], [f"w{i:03d}x" for i in range(150)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(4)) + rng.choices(rare, k=3)).capitalize() for _ in range(900)]
    texts[:4] = ["\u0130W001X W002X", "ALPHA " * 200 + "W003X", "alphathing", "x" * 300]
    keys = [None if i % 97 == 0 else i // 2 for i in range(900)]
    lowered = [t.lower() if t.lower() != "".join(c.lower() if c.isascii() else c for c in t) else None for t in texts]
    asked = [(q, " ".join(rng.sample(common, 2) + rng.choices(rare, k=q % 9) + ["x" * (3 + q % 400)])) for q in range(300)]
    left = pa.table({
        "block": pa.array([0] * 900, pa.int32()), "set": pa.array([5] * 900, pa.int32()), "doc_id": pa.array(keys, pa.int64()),
        "pos": pa.array([0] * 900, pa.int32()), "text": texts, "lowered": pa.array(lowered, pa.string()),
    })
    right = pa.table({"q_id": pa.array([q for q, _ in asked], pa.int64()), "terms": [t for _, t in asked]})
    found = best_in_block(4, 600, part=64)(left, right).to_pylist()
    held = defaultdict(list)
    for i, key in enumerate(keys):
        held[key].append(i)
    want = set()
    for q, terms in asked:
        score = {key: sum(any(t in texts[i].lower() for i in own) for t in terms.split()) for key, own in held.items()}
        ranked = sorted((-n, key is not None, key or 0) for key, n in score.items() if n)[:4]
        want |= {(q, key if known else None, -n) for n, known, key in ranked}
    assert {(r["q_id"], r["doc_id"], r["score"]) for r in found if r["score"]} == want
    said = sorted(r["sentence"] for r in found if not r["score"])
    assert said == sorted(texts[i][:600] for key in {k for _, k, _ in want} for i in held[key])
