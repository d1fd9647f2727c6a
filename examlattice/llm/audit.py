"""What each filter of a cleaning pipeline does in each order, from counters that a stream keeps up to date.

All files go through as available-now micro-batches. A document's failures are a mask of five bits; the fifth (a copy of a document
with a smaller id) can change later, so each text keeps in a keyed state the smallest id seen and who holds it. When a smaller id
arrives, the former holders' masks are retracted from their parts' counters and added again with the fifth bit. What a micro-batch
adds and retracts is written once for its number, so a batch that is run again replaces itself. Every order and step then follows
from the counters alone: 32 masks a part, however many documents there are.

The state's keys are small buckets of text digests (some 32 texts each, as many buckets as the number of rows asks for), since a call
of Python for each single text costs more than all else. State lies where the session's state store provider keeps it: Spark's own keeps it in
memory, and very large corpora want its RocksDB provider (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import BROADCAST_IDS, Scratch, shared_folder

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]"
GOOD, TOXIC = 1, 2
TEXTS = 32  #: texts of a bucket, on average
#: How a combined row stands to the other rows of its text in the same Arrow batch.
LEAST, LATER, FREE = 0, 1, 2
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def mask(text: Column) -> Column:
    """The bits of the four filters that see one text: few words (A), repeated words (B), capitals (C), symbols (D)."""
    pieces = F.split(text, f"{SPACE}+", -1)
    spaces = [" ", "\t", "\n", "\u000b", "\f", "\r"]
    first, last = F.left(text, F.lit(1)).isin(spaces).cast("int"), F.right(text, F.lit(1)).isin(spaces).cast("int")
    empty = F.length(text) == 0
    words = F.when(empty, 0).otherwise(F.size(pieces) - first - last)
    distinct = F.when(empty, 0).otherwise(F.size(F.array_distinct(pieces)) - F.greatest(first, last))
    fails = [words < 200, 100 * distinct < 50 * words, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]")]
    out = F.lit(0)
    for i, f in enumerate(fails):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text in an Arrow batch become few: those with the smallest id, and counts of the later ones, which are copies whatever
    else comes. A text that a third of all rows share is then no hot key."""
    for rows in batches:
        rows = rows.groupby(["digest", "mask", "doc_id", "part", "lab"], dropna=False, sort=False, as_index=False).size().rename(columns={"size": "n"})
        least = rows.groupby("digest")["doc_id"].transform("min")
        rows["state"] = LATER
        rows.loc[rows["doc_id"] == least, "state"] = LEAST
        rows.loc[rows["doc_id"].isna(), "state"] = FREE
        later = rows["state"] == LATER
        some = rows[later].groupby(["digest", "mask", "part", "lab", "state"], sort=False, as_index=False)["n"].sum()
        some["doc_id"] = None
        rows = pd.concat([rows[~later], some])
        ids = ["" if pd.isna(x) else str(int(x)) for x in rows["doc_id"].astype("Int64")]
        packed = [f"{digest} {m} {i} {state} {lab} {n} {part}" for digest, m, i, state, lab, n, part in zip(rows["digest"], rows["mask"], ids, rows["state"], rows["lab"], rows["n"], rows["part"])]
        yield pd.DataFrame({"row": packed})


def retract(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A bucket's rows of a micro-batch against its state (of each text the smallest id and its holders): what the counters gain and lose.
    Rows are single strings, as each column costs a conversion for each bucket."""
    known: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    change, seen = Counter(), False
    for rows in frames:
        for row in rows["row"]:
            digest, m, doc_id, kind, lab, n, part = row.split(" ", 6)
            m, kind, lab, n = int(m), int(kind), int(lab), int(n)
            if kind == FREE:
                change[m, lab, part] += n
                continue
            text = known.get(digest)
            if kind == LATER or (text is not None and int(doc_id) > text[0]):
                change[m | COPY, lab, part] += n
                continue
            if text is None or int(doc_id) < text[0]:
                for held_part, held_lab, k in text[1] if text else ():
                    change[m, held_lab, held_part] -= k
                    change[m | COPY, held_lab, held_part] += k
                text = known[digest] = [int(doc_id), []]
            text[1].append([part, lab, n])
            change[m, lab, part] += n
            seen = True
    if seen:
        state.update((json.dumps(known),))
    found = [f"{m} {lab} {n} {part}" for (m, lab, part), n in change.items() if n]
    if found:
        yield pd.DataFrame({"row": found})


def counters(spark: SparkSession, documents: str, labels: DataFrame, *, part: str = "lang", text: str = "text", doc_id: str = "doc_id", files: int | None = None) -> DataFrame:
    """(part, mask, lab, n) over the Parquet files under `documents`, read as a stream of `files` files a micro-batch (by default one for
    each core of the cluster). lab: bit 1 for quality = 1, bit 2 for toxic = 1 in any row of labels for the id.

    Null text counts as empty, a null part as the empty string. A row without doc_id is no copy and makes none. Rows that share an
    id are no copies of each other, but all are copies of a smaller id. Without files there are no rows."""
    scratch = Scratch(spark, "audit")
    found = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("id"))
    known = scratch.keep(found.agg((GOOD * F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + TOXIC * F.max(F.when(F.col("toxic") == 1, 1).otherwise(0))).alias("lab")))
    cores = spark.sparkContext.defaultParallelism
    own = spark.newSession()  # the stream's settings are its own
    for name, value in {
        "spark.sql.shuffle.partitions": 2 * cores, "spark.sql.streaming.stateStore.providerClass": spark.conf.get("spark.sql.streaming.stateStore.providerClass"),
        "spark.sql.execution.arrow.maxRecordsPerBatch": 10_000, "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
    }.items():
        own.conf.set(name, value)
    labelled = own.read.schema(known.schema).parquet(known._scratch_path)
    if known.count() <= BROADCAST_IDS:
        labelled = F.broadcast(labelled)
    glob = documents.rstrip("/")  # a stream reads folders, and a single file only as a pattern
    glob = f"{glob[:-1]}[{glob[-1]}]"
    docs = own.readStream.schema(own.read.parquet(documents).schema).option("maxFilesPerTrigger", files or cores).parquet(glob)
    docs = docs.select(F.coalesce(text, F.lit("")).alias("t"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    docs = docs.select(F.base64(F.unhex(F.sha2("t", 256))).alias("digest"), mask(F.col("t")).alias("mask"), "doc_id", "part")
    docs = docs.join(labelled, F.col("doc_id") == F.col("id"), "left").select("digest", "mask", "doc_id", "part", F.coalesce("lab", F.lit(0)).alias("lab"))
    rows = docs.mapInPandas(combine, "row string")
    bucket = F.pmod(F.xxhash64(F.substring_index("row", " ", 1)), F.lit(1 + own.read.parquet(documents).count() // TEXTS)).alias("bucket")
    changes = rows.select(bucket, "row").groupBy("bucket").applyInPandasWithState(retract, "row string", "texts string", "update", "NoTimeout")
    root, schema = f"{shared_folder(spark)}/{scratch.root.rsplit('/', 1)[1]}-stream", "part string, mask int, lab int, n long"
    written: dict[int, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        path = f"{root}/changes/{number}"
        fields = F.split("row", " ", 4)
        rows = batch.select(*[fields[i].cast("int" if i < 2 else "long").alias(c) for i, c in enumerate(("mask", "lab", "n"))], fields[3].alias("part"))
        rows.groupBy("part", "mask", "lab").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(path)
        written[number] = path

    query = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(schema).parquet(*written.values()) if written else spark.createDataFrame([], schema)
    total = scratch.keep(changes.groupBy("part", "mask", "lab").agg(F.sum("n").alias("n")).where("n != 0"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    scratch.drop(known)
    return total


def interactions(counted: DataFrame) -> DataFrame:
    """What counters say of every order of the filters: (part, filter_order, step, and the COUNTS), zeros included."""
    n, m = F.col("n"), F.col("mask")
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    bit_of = lambda x: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), x) - 1)
    rows = counted.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letters = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    rows = rows.select("*", bit_of(F.substr("filter_order", F.col("step"), F.lit(1))).alias("bit"), F.aggregate(letters, F.lit(0), lambda a, x: a + bit_of(x)).alias("before"))
    fails, passed = m.bitwiseAND(F.col("bit")) > 0, m.bitwiseAND(F.col("before")) == 0
    has = lambda flag: F.col("lab").bitwiseAND(F.lit(flag)) > 0
    every = len(list(permutations(FILTERS)))
    values = [
        F.when(~fails & passed, n), F.when(fails & passed, n), F.when(fails & ~passed, n), F.when(m == F.col("bit"), n), F.when(fails & passed & has(GOOD), n), F.when(fails & passed & has(TOXIC), n),
        F.when(fails, n * F.floor(F.lit(every) / F.bit_count(m))),  # each of the failing filters comes first in as many orders
    ]
    return rows.groupBy("part", "filter_order", "step").agg(*[F.sum(F.coalesce(v, F.lit(0).cast("long"))).cast("long").alias(c) for v, c in zip(values, COUNTS)]).select("part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS)
