"""The pipeline against plain versions of its stages, on a small table with planted cases."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import crc, plain_components
from veilscan.llm import secrets
from veilscan.llm.tokens import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    """(documents, labels, benchmark): toxic, near copies, benchmark passages, secrets, odd texts, a repeated doc_id."""
    draw = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    docs, labels = [], []
    for k in range(-200, 200):
        toxic = k % 5 == 0
        body = text(60).split()
        if toxic:
            for place in range(5, 50, 3):
                body[place] = draw.choice(["vileslur", "badfilth", "hatecurse"])
        docs.append((k, " ".join(body)))
        if k < 150:
            labels.append((k, int(toxic)))
    base = text(200).split()
    for k in range(300, 312):
        copy = list(base)
        copy[draw.randrange(200)] = f"changed{k}"
        docs.append((k, " ".join(copy)))
    docs += [(312, " ".join(base)), (312, " ".join(base)), (313, " ".join(base).upper())]
    items = [(1, "Alpha, beta! " + text(18)), (2, "only four words here"), (3, None), (4, "--"), (5, text(12))]
    docs += [
        (400, f"{text(40)}. {items[0][1].upper()} -- {text(30)}"), (401, items[0][1]), (402, f"{text(25)}; only FOUR\nwords here; {text(9)}"),
        (403, f"{items[4][1]} {items[0][1]} {text(80)}"), (404, f"{text(20)} password=hunter2secret! and token: abcdef123456 {text(5)}"),
        (405, None), (406, ""), (407, " \n"), (408, "é " * 5000), (409, "pwd: xK9#vQ2!mZ7p"), (None, text(30)),
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    return rows, labels, items


def without_toxic(rows):
    return [r for r in rows if not any(w in (r[1] or "") for w in ("vileslur", "badfilth", "hatecurse"))]


def without_copies(rows):
    """Of each component the smallest doc_id, one row of it."""
    component = {(d, n): c for d, n, c in plain_components([(r[0], r[1]) for r in rows], 5, 80, 100)}
    sizes = [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ()) for w in ((r[1] or "").lower().split() for r in rows)]
    kept, met = [], set()
    for r, n in zip(rows, sizes):
        if n and component[r[0], n] is not None and (component[r[0], n] != r[0] or r[0] in met):
            continue
        met.add(r[0])
        kept.append(r)
    return kept


def without_passages(rows, items):
    windows = set()
    for _, text in items:
        w = [x.lower() for x in WORD.findall(text or "")]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    kept = []
    for r in rows:
        spans = [m.span() for m in WORD.finditer(r[1] or "")]
        w, hit = [r[1][a:b].lower() for a, b in spans], set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
        if hit and 2 * len(hit) >= len(w):
            continue
        text = r[1]
        for k in sorted(hit, reverse=True):
            # from a hit word to the next one, if that is hit too
            end = spans[k + 1][0] if k + 1 in hit else spans[k][1]
            text = text[: spans[k][0]] + text[end:]
        kept.append((r[0], text, *r[2:4], len(text) if hit else r[4]))
    return kept


def without_secrets(rows):
    out = []
    for r in rows:
        spans = secrets.spans_of((r[1] or "").encode())[1]
        text = secrets.redact(r[1], spans) if spans else r[1]
        out.append((r[0], text, *r[2:4], len(text) if spans else r[4]))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_plain_stages(spark, tables):
    rows, _, items = corpus()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    plain = [without_toxic, without_copies, lambda r: without_passages(r, items), without_secrets]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for (name, stage), step in zip(corpus_pipeline.STAGES, plain):
        docs, rows = stage(spark, docs, tables), step(rows)
        assert docs.columns == COLUMNS, name
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str), name
    packed = corpus_pipeline.run(spark, tables).collect()
    want, library = [], Tokenizer.from_file(default_tokenizer())
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert sorted((tuple(r)[:5] for r in packed), key=str) == sorted(want, key=str)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
