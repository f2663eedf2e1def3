"""Chunks, nearest chunks by vector, and the context handed to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.arrays import in_blocks, running_state
from veilscan.functions.narrative import question_prompt
from veilscan.functions.text import chunk_count, is_blank, pieces_sql, strip
from veilscan.operators.pin import pinned
from veilscan.settings import DEFAULT_OPTIONS, Options

WINDOW_CHUNKS = 64
#: Chunk numbers of a document that are compared in one task.
RANGE_CHUNKS = 4096


def chunk_text(docs: DataFrame, key: str = "doc_id", text: str = "text", options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """``(key, chunk_no, start, chunk)``: fixed-stride chunks that overlap.

    Blank texts have no chunk.  Long texts are cut into windows of many chunks first,
    so that finding a chunk does not walk the whole text from its beginning each time.
    """
    step = options.chunk_size - options.chunk_overlap
    wide = (WINDOW_CHUNKS - 1) * step + options.chunk_size
    counted = pinned(docs.select(key, F.col(text).alias("_text")), _n=chunk_count(F.col("_text"), options))
    windows = F.expr(
        f"transform(sequence(0, cast(ceil(_n / {WINDOW_CHUNKS}) as int) - 1), w -> named_struct("
        f"'first', w * {WINDOW_CHUNKS}, 'many', least({WINDOW_CHUNKS}, _n - w * {WINDOW_CHUNKS}), "
        f"'part', substring(_text, w * {WINDOW_CHUNKS * step} + 1, {wide})))"
    )
    parts = counted.where("_n > 0").select(key, F.explode(windows).alias("_w"))
    chunks = F.expr(
        "transform(sequence(0, _w.many - 1), i -> named_struct('chunk_no', _w.first + i, "
        f"'start', (_w.first + i) * {step}, 'chunk', substring(_w.part, i * {step} + 1, {options.chunk_size})))"
    )
    return parts.select(key, F.explode(chunks).alias("_c")).select(key, "_c.chunk_no", "_c.start", "_c.chunk")


def pack_text(docs: DataFrame, key: str = "doc_id", text: str = "text", options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """``(key, chunk_no, start, chunk)``: chunks of whole paragraphs, sentences or words.

    A fold over the pieces of a text (``pieces_sql``) closes a chunk before the piece that would make it longer than
    ``chunk_size``.  The next one begins with as many of the last pieces as fit into ``chunk_overlap`` and leave
    room for that piece.  A chunk is ``text[start : start + length(chunk)]``; blank ones are left out.
    """
    size, overlap = options.chunk_size, options.chunk_overlap
    whole = docs.where(~is_blank(F.col(text))).select(key, F.col(text).alias("_text"))
    cut = pinned(whole, _pieces=F.expr(pieces_sql("_text", size))).select(key, "_pieces")
    sized = pinned(cut, _lens=F.expr("transform(_pieces, p -> length(p))"))
    placed = pinned(sized, _at=F.expr(running_state("_lens", "s + x")))
    upto = "(_at[i] + _lens[i] - _at[{}])"
    carried = f"filter(sequence(acc_.lo, i), f -> _at[i] - _at[f] <= {overlap} and {upto.format('f')} <= {size})[0]"
    fold = (
        "aggregate(part_, named_struct('lo', coalesce(try_element_at(done_, -1).lo, 0), "
        "'cuts', cast(array() as array<struct<lo:int,hi:int>>)), "
        f"(acc_, i) -> if({upto.format('acc_.lo')} > {size}, named_struct('lo', {carried}, "
        "'cuts', concat(acc_.cuts, array(named_struct('lo', acc_.lo, 'hi', i)))), acc_))"
    )
    blocks = (
        f"aggregate({in_blocks('sequence(0, size(_pieces) - 1)')}, "
        "cast(array() as array<struct<lo:int,cuts:array<struct<lo:int,hi:int>>>>), "
        f"(done_, part_) -> concat(done_, array({fold})))"
    )
    folded = pinned(placed, _blocks=F.expr(blocks))
    cuts = "concat(flatten(transform(_blocks, b -> b.cuts)), array(named_struct('lo', element_at(_blocks, -1).lo, 'hi', size(_pieces))))"
    chunks = F.expr(
        f"transform({cuts}, (c, k) -> named_struct('chunk_no', k, 'start', _at[c.lo], "
        "'chunk', array_join(slice(_pieces, c.lo + 1, c.hi - c.lo), '')))"
    )
    rows = folded.select(key, F.explode(chunks).alias("_c")).select(key, "_c.chunk_no", "_c.start", "_c.chunk")
    return rows.where(~is_blank(F.col("chunk")))


def squared_l2(a: str, b: str) -> Column:
    """Squared Euclidean distance of two vectors, in double precision."""
    return F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> pow(cast(x as double) - cast(y as double), 2)), "
        "cast(0 as double), (acc, q) -> acc + q)"
    )


def scored_chunks(questions: DataFrame, chunks: DataFrame, key: str = "doc_id", range_chunks: int = RANGE_CHUNKS) -> DataFrame:
    """``(q_id, key, chunk_no, distance)`` of every chunk of a question's document.

    ``questions(q_id, key, q_vector)`` meets ``chunks(key, chunk_no, vector)`` on the document and on a range of
    ``range_chunks`` chunk numbers, so a document with very many chunks is spread over as many tasks as it has
    ranges; its questions are repeated once for each.
    """
    part = F.floor(F.col("chunk_no") / range_chunks).alias("_part")
    ranges = chunks.select(key, part).distinct()
    asked = questions.select("q_id", key, "q_vector").join(ranges, key)
    return chunks.select("*", part).join(asked, [key, "_part"]).select(
        "q_id", key, "chunk_no", squared_l2("vector", "q_vector").alias("distance")
    )


def nearest_chunks(
    questions: DataFrame, chunks: DataFrame, k: int = DEFAULT_OPTIONS.retriever_k, key: str = "doc_id",
    range_chunks: int = RANGE_CHUNKS,
) -> DataFrame:
    """The k nearest chunks of each question within its document, ranked on two levels.

    The ranked window keeps k rows per question in every task before the shuffle, and then over all tasks, so a
    document with very many chunks sends only its best ones.
    """
    order = Window.partitionBy("q_id").orderBy("distance", "chunk_no")
    scored = scored_chunks(questions, chunks, key, range_chunks)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def question_context(nearest: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(q_id, key, context, sources)`` from ranked chunks; at most k per question."""
    texts = nearest.join(chunks.select(key, "chunk_no", "chunk"), [key, "chunk_no"])
    ranked = texts.groupBy("q_id", key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("_ranked")
    )
    sources = F.transform("_ranked", lambda r: r["chunk"])
    return ranked.select("q_id", key, F.array_join(sources, "\n\n").alias("context"), sources.alias("sources"))


def question_requests(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """Model request per question, with the sources it may cite."""
    asked = questions.select("q_id", strip("question").alias("question"))
    return contexts.join(asked, "q_id").select(
        "q_id",
        F.lit("question").alias("kind"),
        question_prompt(F.col("context"), F.col("question")).alias("prompt"),
        "sources",
    )
