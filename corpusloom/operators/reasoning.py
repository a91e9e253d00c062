"""Citations, prompts and traces over links and similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import links as L
from corpusloom.operators.retrieval import _matrix
from corpusloom.sources.scratch import materialise

# Citation patterns and prompt wording, which results have to match.
CITATION = r"\[ref:([^:\]\n]+):(\d+)-(\d+)\]"
SHA_CITATION = r"\[sha:([a-f0-9]{7,40})\s*@\s*([0-9T:\-Z.]+)\]"
#: Rows of a frontier and chunks that one task holds; more are met in blocks.
MAX_FRONTIER, MAX_CHUNKS = 10_000, 16_384
NO_HOPS = "No relevant notes were found for this question."


def extract_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, note_path, byte_start, byte_end) of each [ref:path:start-end], repeats kept."""
    zipped = F.arrays_zip(*[T.all_groups("text", CITATION, i).alias(f"g{i}") for i in (1, 2, 3)])
    each = answers.select("answer_id", F.posexplode(zipped).alias("pos", "c"))
    return each.select("answer_id", F.col("pos").cast("long"), F.col("c.g1").alias("note_path"), F.col("c.g2").cast("long").alias("byte_start"), F.col("c.g3").cast("long").alias("byte_end"))


def validate_citations(citations: DataFrame, hops: DataFrame) -> DataFrame:
    """Adds valid: whether the exact (note_path, byte_start, byte_end) is among the hops."""
    known = hops.select("note_path", "byte_start", "byte_end").distinct().withColumn("_ok", F.lit(True))
    return citations.join(known, ["note_path", "byte_start", "byte_end"], "left").withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")


def extract_shas(answers: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(T.all_groups("text", SHA_CITATION, 1).alias("sha"), T.all_groups("text", SHA_CITATION, 2).alias("day"))
    return answers.select("answer_id", F.posexplode(zipped).alias("pos", "c")).select("answer_id", F.col("pos").cast("long"), F.col("c.sha").alias("sha"), F.col("c.day").alias("day"))


def validate_shas(citations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Adds valid: exactly one revision's sha starts with the cited one. Both meet by the seven characters that all have."""
    known = revisions.select(F.col("sha").alias("full"), F.substring("sha", 1, 7).alias("_k"))
    met = citations.withColumn("_k", F.substring("sha", 1, 7)).join(known, "_k", "left")
    hit = F.startswith("full", F.col("sha"))
    return met.groupBy("answer_id", "pos", "sha", "day").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("n")).select("answer_id", "pos", "sha", "day", (F.col("n") == 1).alias("valid"))


def clip(text: Column, n: int = 300) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def compose_prompts(questions: DataFrame, hops: DataFrame) -> DataFrame:
    """(question_id, prompt): the question and its numbered citations (question_id, ord, note_path, byte_start, byte_end, heading, text)."""
    item = F.concat(F.lit("#"), (F.col("ord") + 1).cast("string"), F.lit(" [ref:"), F.col("note_path"), F.lit(":"), F.col("byte_start").cast("string"), F.lit("-"), F.col("byte_end").cast("string"), F.lit("] heading: "), F.col("heading"), F.lit("\n   text: "), clip(F.col("text")))
    listed = hops.select("question_id", "ord", item.alias("item")).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("all"))
    joined = questions.join(listed, "question_id", "left")
    body = F.when(F.col("all").isNull(), "Available citations: (none)").otherwise(F.concat(F.lit("Available citations:\n"), F.array_join(F.transform("all", lambda x: x["item"]), "\n")))
    return joined.select("question_id", F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\n"), body).alias("prompt"))


def narrate_prompts(revisions: DataFrame) -> DataFrame:
    """(note_path, prompt): a note's revisions, oldest first, with short sha, day, message and the start of the content."""
    order = Window.partitionBy("note_path").orderBy("commit_ts", "sha")
    item = F.concat(F.lit("#"), F.col("n").cast("string"), F.lit(" [sha:"), F.substring("sha", 1, 7), F.lit(" @ "), F.date_format("commit_ts", "yyyy-MM-dd"), F.lit("] "), F.col("message"), F.lit("\n   body: "), clip(F.coalesce("content", F.lit("(content unavailable)"))))
    listed = revisions.withColumn("n", F.row_number().over(order)).select("note_path", "n", item.alias("item")).groupBy("note_path").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("all"))
    return listed.select("note_path", F.concat(F.lit("Note: "), F.col("note_path"), F.lit("\n\nRevisions (oldest first):\n"), F.array_join(F.transform("all", lambda x: x["item"]), "\n")).alias("prompt"))


def answer_stub(prompts: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, answer): an offline stand-in for a chat model that gives back the prompt's first 2000 characters."""
    return prompts.select(key, F.concat(F.lit("[stub] "), F.substring("prompt", 1, 2000)).alias("answer"))


def _nearest(vec: DataFrame, front: DataFrame, keep: int, min_score: float) -> DataFrame:
    """(question_id, from_id, front, chunk_id, score): chunks of other notes with a score of at least ``min_score``.

    Frontier rows are counted and dealt to blocks that meet blocks of chunks, so that a task holds one block of either
    and sends the ``keep`` best of each row, ties to the lower chunk; the best of all blocks are among them.
    """
    blocks = max(1, -(-front.count() // MAX_FRONTIER))
    parts = max(1, -(-vec.count() // MAX_CHUNKS))
    part = lambda n, *names: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = front.where(F.col("from_note").isNotNull()).withColumn("_q", part(blocks, "question_id", "from_id")).withColumn("_c", each(parts))
    rows = vec.where(F.col("note_path").isNotNull()).withColumn("_c", part(parts, "chunk_id")).withColumn("_q", each(blocks))
    schema = S.StructType([front.schema[n] for n in ("question_id", "from_id", "front")] + [vec.schema["chunk_id"], S.StructField("score", S.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, to, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            a, b = _matrix(left["from_vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
            own, notes, ids = left["from_note"].to_pylist(), np.array(right["note_path"].to_pylist(), dtype=object), right["chunk_id"].to_numpy()
            length = np.linalg.norm(b, axis=1).max()
            for i in range(len(a)):
                rough = b @ a[i]
                slack = 1e-11 * length * np.linalg.norm(a[i])  # beyond the rounding of any order of the sum
                fit = np.flatnonzero(rough >= min_score - slack)
                fit = fit[notes[fit] != own[i]]
                if len(fit) > keep:
                    fit = fit[rough[fit] >= np.partition(rough[fit], len(fit) - keep)[len(fit) - keep] - slack]
                if len(fit):
                    exact = np.add.accumulate(b[fit] * a[i], axis=1)[:, -1]  # in order of the elements, as V.dot
                    best = np.lexsort((ids[fit], -exact))[:keep]
                    best = best[exact[best] >= min_score]
                    at.append(np.full(len(best), i))
                    to.append(fit[best])
                    scores.append(exact[best])
        found = left.select(["question_id", "from_id", "front"]).take(pa.array(np.concatenate(at)))
        return found.append_column("chunk_id", right["chunk_id"].take(pa.array(np.concatenate(to)))).append_column("score", pa.array(np.concatenate(scores)))

    return asked.groupBy("_c", "_q").cogroup(rows.groupBy("_c", "_q")).applyInArrow(run, schema)


def trace(chunks: DataFrame, links: DataFrame, notes: DataFrame, seeds: DataFrame, max_depth: int = 2, knn: int = 3, min_score: float = 0.5, max_hops: int = 30) -> DataFrame:
    """(question_id, step, from_id, to_id, edge, score, ord): how an answer can be reached from seed chunks.

    Level by level, links of the whole frontier first, then its nearest chunks of other notes; a chunk is visited
    once a question, by the first edge in order (place in the frontier, then link and chunk, or then similarity), and
    a question has ``max_hops`` hops at most. Each level is one set of joins for all questions. Nearest chunks are
    ranked among chunks that links have not visited; of chunks that two frontier chunks want the earlier one has it.
    """
    vec = chunks.select("chunk_id", "note_path", "vec")
    to = L.resolve(links, notes).where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select(F.col("src").alias("from_note"), F.col("pos").alias("link_pos"), F.col("dst").alias("note_path"))
    hops = seeds.select("question_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("from_id"), F.col("chunk_id").alias("to_id"), F.lit("seed").alias("edge"), "score", (F.col("rank") - 1).cast("long").alias("ord")).where(F.col("ord") < max_hops)
    hops = materialise(hops)
    for level in range(1, max_depth + 1):
        front = hops.where(F.col("step") == level - 1).select("question_id", F.col("to_id").alias("from_id"), F.col("ord").alias("front"))
        front = front.join(vec.select(F.col("chunk_id").alias("from_id"), F.col("note_path").alias("from_note"), F.col("vec").alias("from_vec")), "from_id")
        for edge in ("wikilink", "knn"):
            if edge == "wikilink":
                found = front.join(to, "from_note").join(vec, "note_path").withColumn("turn", F.struct(F.col("front"), F.col("link_pos").cast("double").alias("x"), F.col("chunk_id").alias("y")))
                scored = found.withColumn("score", V.dot(F.col("from_vec"), F.col("vec")))
            else:
                # a question has visited max_hops chunks at most, so its nearest fresh ones are among so many more
                scored = _nearest(vec, front.select("question_id", "from_id", "front", "from_note", "from_vec"), knn + max_hops, min_score)
                scored = scored.withColumn("turn", F.struct(F.col("front"), (-F.col("score")).alias("x"), F.col("chunk_id").alias("y")))
            fresh = scored.join(hops.select("question_id", F.col("to_id").alias("chunk_id")), ["question_id", "chunk_id"], "left_anti")
            if edge == "knn":
                near = Window.partitionBy("question_id", "from_id").orderBy(F.desc("score"), "chunk_id")
                fresh = fresh.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= knn)
            claim = fresh.groupBy("question_id", "chunk_id").agg(F.min_by(F.struct("from_id", "score", "turn"), "turn").alias("c"))
            done = hops.groupBy("question_id").agg(F.max("ord").alias("last"))
            numbered = claim.select("question_id", "chunk_id", "c.*").join(done, "question_id")
            numbered = numbered.withColumn("ord", F.col("last") + F.row_number().over(Window.partitionBy("question_id").orderBy("turn")))
            new = numbered.where(F.col("ord") < max_hops).select("question_id", F.lit(level).alias("step"), "from_id", F.col("chunk_id").alias("to_id"), F.lit(edge).alias("edge"), "score", "ord")
            hops = materialise(hops.unionByName(new))
    return hops
