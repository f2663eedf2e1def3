"""Questions over all documents at once: sentences in blocks, a block inverted where it meets the questions.

A question's terms count where they occur in a sentence, inside words too.  Terms hold no white space, so an occurrence
lies within one word.  The index holds each sentence once.  Sentences are dealt into blocks of bounded size, and so are
questions; every question meets every block.  A task splits its block's sentences into words, finds the terms in the
distinct words by the hashes of all their runs, and so the sentences of each term.  Only sentences and questions move,
the former once for a set of questions, the latter once for a block, and what a block finds: its best, and the text of
each of these once.

Pairs of questions and sentences never become rows.  Some long sentences of the block tell first how many terms a
question's best ones have at least.  To have w terms of n, a sentence needs one of the n - w + 1 rarest, and two of one
more, so that these terms' sentences are the only ones to look at; common terms are bitmaps, looked up for them, and a sentence is dropped
when the terms left can't bring it to w.  The work still grows with questions times sentences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from veilscan.functions.text import compact_sql, search_terms, sentences_sql
from veilscan.settings import DEFAULT_OPTIONS, Options

#: Sentences, and their bytes, of one task, about; fewer, but not under LEAST, where there are too few blocks for the cores.
BLOCK, BYTES, LEAST = 1 << 19, 1 << 26, 1 << 17
#: Questions, and bytes of their terms, of one task, about.
ASKED, ASKED_BYTES = 1 << 18, 1 << 26
#: Sentences that are inverted at once; the longest ones, and of these the ones with most of what is asked for, which
#: are scored first.
PART, LONGEST, FIRST = 1 << 17, 4096, 512
#: A term in more than one of so many sentences gets a bitmap, while there are fewer than BITMAPS.
COMMON, BITMAPS = 256, 2048
#: Sentences, about, for which all common terms are looked up at once, not one after the other.
FEW = 1024
#: Hits of a term in a sentence, about, that are written out at once.
HITS = 1 << 20


@dataclass(frozen=True)
class SentenceIndex:
    """``sentences(key, pos, sentence, rest)``, dealt into blocks of about ``block``; ``rest`` is what display clips."""

    sentences: DataFrame
    block: int = BLOCK


def sentence_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "masked_text", options: Options = DEFAULT_OPTIONS
) -> DataFrame:
    """``(key, pos, sentence, rest)``: non-blank sentences, clipped for display, and what is clipped."""
    split = docs.select(key, F.posexplode(F.expr(f"transform({sentences_sql(text)}, raw -> {compact_sql('raw')})")).alias("pos", "_flat"))
    clip = options.sentence_chars
    rest = F.when(F.length("_flat") > clip, F.substr("_flat", F.lit(clip + 1)))
    return split.where("_flat != ''").select(key, "pos", F.left("_flat", F.lit(clip)).alias("sentence"), rest.alias("rest"))


def build_sentence_index(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "masked_text", options: Options = DEFAULT_OPTIONS, block: int = BLOCK
) -> SentenceIndex:
    """Write the index of documents below a shared folder and open it; the texts are read once."""
    sentence_rows(docs, key, text, options).write.option("compression", "zstd").parquet(f"{folder}/sentences")
    return open_sentence_index(docs.sparkSession, folder, block)


def open_sentence_index(spark: SparkSession, folder: str, block: int = BLOCK) -> SentenceIndex:
    return SentenceIndex(spark.read.parquet(f"{folder}/sentences"), block)


def best_in_block(k: int, clip: int, part: int = PART) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of sentences and one of questions, the k best sentences of each question, and their texts.

    The functions stand inside, so that they go to the tasks by value and these need not find this package.
    """

    def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of strings, one after the other, and where each begins and the last ends."""
        texts = texts.cast(pa.large_binary())
        _, begins, data = texts.buffers()
        begins = np.frombuffer(begins, np.int64, len(texts) + 1, texts.offset * 8)
        return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]] if len(texts) else np.zeros(0, np.uint8), begins - begins[0]

    def each_once(values: np.ndarray) -> np.ndarray:
        values.sort()  # np.unique hashes, which takes many times longer here
        return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values

    def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
        """begin, begin + 1, ..., as many of each."""
        at = np.repeat(begin - (np.cumsum(many) - many), many)
        at += np.arange(len(at))
        return at

    by = np.uint64(0x9E3779B97F4A7C15)

    def hashed(terms: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length, the terms' hashes in order, and these terms."""
        data, begins = characters(terms)
        long = np.diff(begins)
        order = np.argsort(-long, kind="stable")
        at, sizes, codes, out = begins[order], long[order], np.zeros(len(order), np.uint64), {}
        for n in range(1, int(long.max(initial=0)) + 1):
            alive = int(np.searchsorted(-sizes, -n, "right"))
            codes[:alive] = codes[:alive] * by + data[at[:alive] + (n - 1)]
            ended = slice(int(np.searchsorted(-sizes, -n, "left")), alive)
            if ended.start < alive:
                by_code = np.argsort(codes[ended], kind="stable")
                out[n] = codes[ended][by_code], order[ended][by_code]
        return out

    def words_with_terms(words: pa.Array, terms: pa.Array, of_terms: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Pairs of a term and a word that it stands in, each once, as ``term << 32 | word``, in order."""
        data, begins = characters(words)
        said, said_at = characters(terms)
        if not len(data) or not of_terms:
            return np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(begins))
        ends = begins[1:].astype(np.int32)[word]
        at, code, found = np.arange(len(data), dtype=np.int32), np.zeros(len(data), np.uint64), []
        for n in range(1, max(of_terms) + 1):
            alive = at + n <= ends[at]
            if not alive.all():
                at, code = at[alive], code[alive]
            if not len(at):
                break
            code = code * by + data[at + (n - 1)]
            if n not in of_terms:
                continue
            sought, own = of_terms[n]
            likely = np.zeros(1 << 20, bool)
            likely[sought >> np.uint64(44)] = True
            spots = np.flatnonzero(likely[code >> np.uint64(44)])
            low = np.searchsorted(sought, code[spots])
            most = int(np.diff(np.flatnonzero(np.r_[True, sought[1:] != sought[:-1], True])).max())
            for more in range(most):  # one, unless terms share a hash
                here = np.minimum(low + more, len(sought) - 1)
                same = (sought[here] == code[spots]) & (low + more < len(sought))
                where, term = at[spots[same]], own[here[same]]
                for i in range(n):  # equal hashes may still be of other characters
                    equal = data[where + i] == said[said_at[term] + i]
                    if not equal.all():
                        where, term = where[equal], term[equal]
                found.append(each_once(term.astype(np.int64) << 32 | word[where]))
        return each_once(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def inverted(
        texts: pa.Array, places: np.ndarray, size: int, terms: pa.Array, of_terms: dict[int, tuple[np.ndarray, np.ndarray]]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the list of each term's places begins, these lists, bitmaps of common terms, and each term's bitmap or -1."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        vocabulary, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        where = np.repeat(places, np.asarray(split.value_lengths()))
        del split, coded
        where = each_once(codes << 32 | where)  # the places of each word
        freq = np.bincount(where >> 32, minlength=len(vocabulary))
        begin = np.cumsum(freq) - freq
        where = (where & 0xFFFFFFFF).astype(np.int32)
        pairs = words_with_terms(vocabulary, terms, of_terms)
        term, word = pairs >> 32, pairs & 0xFFFFFFFF
        many = freq[word]
        counts, lists, bitmaps, row = np.zeros(len(terms), np.int64), [], [], np.full(len(terms), -1)
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
        before = np.cumsum(many) - many
        cut = np.flatnonzero(np.diff(before[starts] // HITS)) + 1
        for lo, hi in zip(np.r_[0, starts[cut]], np.r_[starts[cut], len(term)]) if len(term) else ():
            hits = where[spread(begin[word[lo:hi]], many[lo:hi])] + np.repeat(term[lo:hi] << 32, many[lo:hi])
            hits = each_once(hits)
            own = term[lo:hi][np.r_[True, term[lo + 1 : hi] != term[lo : hi - 1]]]
            bounds = np.r_[np.searchsorted(hits, own << 32), len(hits)]
            counts[own] = np.diff(bounds)
            hits = (hits & 0xFFFFFFFF).astype(np.int32)
            for i in np.flatnonzero(counts[own] * COMMON > size)[: BITMAPS - len(bitmaps)]:
                flags = np.zeros(size, np.uint8)
                flags[hits[bounds[i] : bounds[i + 1]]] = 1
                row[own[i]] = len(bitmaps)
                bitmaps.append(np.packbits(flags, bitorder="little"))
            lists.append(hits)
        lists = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        return np.r_[0, np.cumsum(counts)], lists, np.stack(bitmaps) if bitmaps else np.zeros((0, 1), np.uint8), row

    def least_scores(texts: pa.Array, terms: pa.Array, of_terms: dict[int, tuple[np.ndarray, np.ndarray]], lists: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The score that each question's k-th best of some of these sentences has, 1 at least."""
        least = np.ones(len(ends), np.int64)
        if len(texts) < k or not len(lists):
            return least
        first, places, _, _ = inverted(texts, np.arange(len(texts)), len(texts), terms, of_terms)
        counts = np.diff(first)
        term = np.repeat(np.arange(len(terms)), counts)
        total = np.bincount(places, np.bincount(lists, minlength=len(terms))[term], len(texts))  # over all questions
        chosen = np.argsort(-total, kind="stable")[:FIRST]
        spot = np.full(len(texts), -1)
        spot[chosen] = np.arange(len(chosen))
        some = spot[places] >= 0
        term, places = term[some], spot[places[some]]
        known = np.flatnonzero(np.bincount(term, minlength=len(terms)))
        row = np.full(len(terms), len(known))
        row[known] = np.arange(len(known))
        longest = int(np.diff(np.r_[0, ends]).max())
        flags = np.zeros((len(known) + 1, len(chosen)), np.uint8 if longest < 256 else np.uint32)
        flags[row[term], places] = 1
        begins = np.r_[0, ends[:-1]]
        asked = np.flatnonzero(ends > begins)
        for some in np.split(asked, np.flatnonzero(np.diff(begins[asked] >> 14)) + 1):
            lo, hi = begins[some[0]], ends[some[-1]]
            scores = np.add.reduceat(flags[row[lists[lo:hi]]], begins[some] - lo, axis=0, dtype=flags.dtype)
            least[some] = np.partition(scores, len(chosen) - k, axis=1)[:, len(chosen) - k]
        return np.maximum(least, 1)

    def in_order(keys: pa.Array, pos: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of keys and positions, unknown keys first; each one's place among the different keys and positions,
        and where each place begins."""
        both = pa.table({"key": keys, "pos": pos})
        order = pc.sort_indices(both, sort_keys=[("key", "ascending"), ("pos", "ascending")], null_placement="at_start")
        codes, at = (np.asarray(x.take(order)) for x in (keys.dictionary_encode(null_encoding="encode").indices, pos))
        new = np.ones(len(order), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])
        return np.asarray(order).astype(np.int64), (np.cumsum(new) - 1).astype(np.int32), np.flatnonzero(new)

    def counted(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of sorted spots, and how often each is there."""
        if not len(spots):
            return spots, np.zeros(0, np.int64)
        edge = np.ones(len(spots) + 1, bool)
        np.not_equal(spots[1:], spots[:-1], out=edge[1:-1])
        edge = edge.nonzero()[0]
        return spots[edge[:-1]], edge[1:] - edge[:-1]

    def run(sentences: pa.Table, asked: pa.Table) -> pa.Table:
        key = sentences.column_names[2]
        schema = pa.schema(
            [("q_id", asked["q_id"].type), (key, sentences[key].type), ("pos", pa.int32()), ("score", pa.int32()), ("set", pa.int32()), ("sentence", sentences["text"].type)]
        )
        if not sentences.num_rows or not asked.num_rows:
            return schema.empty_table()
        said = pc.split_pattern(asked["terms"].combine_chunks(), " ")
        wanted = said.flatten().dictionary_encode()
        terms, lists = wanted.dictionary, np.asarray(wanted.indices)
        ends = np.cumsum(np.asarray(said.value_lengths()).astype(np.int64))
        of_terms, owner = hashed(terms), np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.r_[0, ends]))
        keys, pos, texts, lowered = (sentences[x].combine_chunks() for x in (key, "pos", "text", "lowered"))
        order, place, rows = in_order(keys, pos)

        def lower(at: np.ndarray) -> pa.Array:
            at = pa.array(at)
            return pc.coalesce(lowered.take(at), pc.ascii_lower(texts.take(at)))

        first_rows = order[rows]
        long = np.asarray(pc.binary_length(texts))[first_rows]
        seeds = np.argpartition(-long, LONGEST)[:LONGEST] if len(rows) > LONGEST else np.arange(len(rows))
        need = least_scores(lower(first_rows[seeds]), terms, of_terms, lists, ends).tolist()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for base in range(0, len(rows), part):
            size = min(part, len(rows) - base)
            lo, hi = rows[base], rows[base + size] if base + size < len(rows) else len(place)
            first, places, bitmaps, row = inverted(lower(order[lo:hi]), place[lo:hi] - base, size, terms, of_terms)
            bits, width = bitmaps.reshape(-1), bitmaps.shape[1]
            many = np.diff(first).astype(np.int32)[lists]
            here = np.flatnonzero(many)
            here = here[np.lexsort((many[here], owner[here]))]  # a question's terms, rare ones first
            mine, starts = lists[here], np.searchsorted(owner[here], np.arange(len(ends) + 1))
            reach = np.r_[0, np.cumsum(many[here], dtype=np.int64)]  # how many places its first terms have
            rows_of = row[mine] * width
            del many, here
            for q in np.flatnonzero(np.diff(starts) >= need).tolist():
                start, end, least = int(starts[q]), int(starts[q + 1]), need[q]
                split = end - least + 1
                twice = least > 1 and reach[split + 1] - reach[split] < reach[split] - reach[start]
                split += twice
                spots = np.concatenate([places[first[c] : first[c + 1]] for c in mine[start:split].tolist()])
                spots.sort()
                if twice:  # the other terms are least - 2, else least - 1
                    spots = spots[1:][spots[1:] == spots[:-1]]
                spots, score = counted(spots)
                score += twice
                while split < end and len(spots):
                    if len(spots) <= FEW and rows_of[split:end].min() >= 0:
                        held = bits.take(rows_of[split:end, None] + (spots >> 3)) >> (spots & 7).astype(np.uint8) & 1
                        score = score + held.sum(axis=0)
                        break
                    if rows_of[split] >= 0:
                        score = score + (bits.take(rows_of[split] + (spots >> 3)) >> (spots & 7).astype(np.uint8) & 1)
                    else:
                        held = places[first[mine[split]] : first[mine[split] + 1]]
                        score = score + (held.take(held.searchsorted(spots), mode="clip") == spots)
                    split += 1
                    some = (score >= least - (end - split)).nonzero()[0]
                    spots, score = spots[some], score[some]
                some = (score >= least).nonzero()[0]
                if len(some):
                    spots, score = spots[some] + base, score[some]
                    if q in best:
                        spots, score = np.concatenate([best[q][0], spots]), np.concatenate([best[q][1], score])
                    top = (score == score.max()).nonzero()[0][:k]
                    if len(top) < k:
                        top = np.argsort(-score, kind="stable")[:k]  # equal scores: smaller places first
                    best[q] = spots[top], score[top]
                    if len(top) == k:  # what comes later has larger places
                        need[q] = max(least, int(score[top[-1]]) + 1)
        if not best:
            return schema.empty_table()
        q = np.repeat(np.fromiter(best, np.int64), [len(spots) for spots, _ in best.values()])
        spots = np.concatenate([spots for spots, _ in best.values()])
        at, score = pa.array(first_rows[spots]), pa.array(np.concatenate([score for _, score in best.values()]), pa.int32())
        ranked = [asked["q_id"].take(pa.array(q)), keys.take(at), pos.take(at), score, pa.nulls(len(q), pa.int32()), pa.nulls(len(q), schema.field("sentence").type)]
        # and each text that is among the best, with a score of 0 and no question
        at = pa.array(order[np.isin(place, each_once(spots))])
        clipped = pc.utf8_slice_codeunits(texts.take(at), 0, clip).cast(schema.field("sentence").type)
        said = [pa.nulls(len(at), schema.field("q_id").type), keys.take(at), pos.take(at), pa.array(np.zeros(len(at)), pa.int32()), sentences["set"][: len(at)].combine_chunks(), clipped]
        return pa.concat_tables([pa.Table.from_arrays(x, schema=schema) for x in (ranked, said)])

    return run


def corpus_sentences(
    questions: DataFrame, index: SentenceIndex, key: str = "doc_id", question: str = "question",
    options: Options = DEFAULT_OPTIONS, asked_block: int = ASKED,
) -> DataFrame:
    """``(q_id, rank, score, key, pos, sentence)``: the best sentences of the whole corpus for each question.

    The score is the number of question terms that the sentence contains; ties go to smaller keys and positions.  A task
    ranks the sentences of a block for its questions and gives back the best, and only the winners meet their sentence.
    """
    asked = questions.select("q_id", search_terms(question).alias("terms")).groupBy("q_id").agg(
        F.array_join(F.flatten(F.collect_list("terms")), " ").alias("terms")
    ).where("terms != ''")
    text = F.concat("sentence", F.coalesce("rest", F.lit("")))
    rows, size = index.sentences.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n_asked, asked_size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0))).first()
    cores = index.sentences.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // index.block), -(-size // BYTES), min(2 * cores, -(-rows // LEAST)))
    sets = max(1, -(-n_asked // asked_block), -(-asked_size // ASKED_BYTES))
    # tasks put ASCII letters into lower case themselves
    lowered = F.when(F.lower("text") != F.translate("text", ascii_uppercase, ascii_lowercase), F.lower("text"))
    dealt = index.sentences.select(
        F.pmod(F.xxhash64(key, "pos"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"),
        key, "pos", text.alias("text"),
    ).withColumn("lowered", lowered)
    # other names than ``dealt`` has, so that none is ambiguous
    lists = asked.select(
        "q_id", "terms", F.pmod(F.xxhash64("q_id"), F.lit(sets)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).toDF("q_id", "terms", "_set", "_block")
    kinds = {"q_id": questions.schema["q_id"].dataType, key: index.sentences.schema[key].dataType, "pos": IntegerType(), "score": IntegerType(), "set": IntegerType(), "sentence": StringType()}
    found = dealt.groupBy("block", "set").cogroup(lists.groupBy("_block", "_set")).applyInArrow(
        best_in_block(options.sentence_limit, options.sentence_chars), StructType([StructField(*x) for x in kinds.items()])
    )
    # a question's sentences are ranked, while texts, dealt by their place, keep the first rank
    is_text = F.col("score") == 0
    own = [F.when(is_text, F.col(x)).alias(x) for x in (key, "pos")]
    order = Window.partitionBy("q_id", *own).orderBy(F.desc("score"), key, "pos")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(is_text | (F.col("rank") <= options.sentence_limit))
    # each set of questions that a place is among the best of gives all its texts
    place = Window.partitionBy(key, "pos")
    known = ranked.where(F.col(key).isNotNull()).withColumn("_set", F.min("set").over(place))
    said = known.withColumn("said", F.collect_list(F.when(F.col("set") == F.col("_set"), F.col("sentence"))).over(place))
    return said.where(~is_text).select("q_id", "rank", "score", key, "pos", F.explode("said").alias("sentence"))
