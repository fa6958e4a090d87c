"""Timelines derived from the driver's tables. Times are multiples of 1/64 s, so sums and halvings are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("rec_id"), "turn", F.posexplode(F.split("text", " ")).alias("p", "text"))
    start = F.col("turn") * 40 + F.col("p") * F.lit(0.375)
    return c.select("rec_id", (F.col("turn") * 1_000_000 + F.col("p")).alias("word_idx"), start.alias("start"), (start + 0.25).alias("end"), "text", F.lit(1.0).alias("probability"))


def reference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", " "))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("rec_id"), F.col("turn").alias("turn_idx"), (F.col("turn") * 40).cast("double").alias("start"), (F.col("turn") * 40 + (n - 1) * F.lit(0.375) + 0.25).alias("end"), F.col("role").alias("speaker"))


def hypothesis_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reference_turns(spark, sf_dir).withColumn("c", F.col("rec_id").cast("bigint"))
    shift = ((F.col("turn_idx") * 7 + F.col("c") * 3) % 5 - 2) / F.lit(8.0)
    t = t.where((F.col("c") + F.col("turn_idx")) % 11 != 0)
    return t.select("rec_id", "turn_idx", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), F.concat(F.lit("S"), (F.col("turn_idx") % 3).cast("string")).alias("speaker"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(600_000_000)).cast("double") / 8.0 - 213000
    return e.select(F.col("user_id").cast("string").alias("rec_id"), F.col("event_id").alias("idx"), start.alias("start"), (start + F.floor("value") / F.lit(8.0)).alias("end"))


def labelled_windows(windows: DataFrame) -> DataFrame:
    return windows.withColumn("label", F.pmod(F.floor(F.col("start") / 3).cast("bigint"), F.lit(3)))


def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.functions import normalize_words

    d = table(spark, sf_dir, "documents").select("doc_id", normalize_words(F.col("text")).alias("ref"))
    kept = F.filter("ref", lambda w, i: (i + F.col("doc_id")) % 7 != 0)
    return d.withColumn("hyp", F.transform(kept, lambda w, i: F.when((i * 3 + F.col("doc_id")) % 11 == 0, "zz").otherwise(w)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("rec_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))


#: The same relations as common table expressions of the oracle.
WORDS = """c AS (SELECT CAST(conv_id AS VARCHAR) AS rec_id, turn, string_split(text, ' ') AS ws FROM conversations),
x AS (SELECT rec_id, turn, unnest(ws) AS text, unnest(range(len(ws))) AS p FROM c),
words AS (SELECT rec_id, turn * 1000000 + p AS word_idx, turn * 40 + p * 0.375::DOUBLE AS "start", turn * 40 + p * 0.375::DOUBLE + 0.25 AS "end", text, 1.0::DOUBLE AS probability FROM x)"""
TURNS = """ref AS (SELECT CAST(conv_id AS VARCHAR) AS rec_id, turn AS turn_idx, (turn * 40)::DOUBLE AS "start",
  turn * 40 + (len(string_split(text, ' ')) - 1) * 0.375::DOUBLE + 0.25 AS "end", role AS speaker FROM conversations)"""
HYP = """hyp AS (SELECT rec_id, turn_idx, "start" + ((turn_idx * 7 + CAST(rec_id AS BIGINT) * 3) % 5 - 2) / 8.0::DOUBLE AS "start",
  "end" + ((turn_idx * 7 + CAST(rec_id AS BIGINT) * 3) % 5 - 2) / 8.0::DOUBLE AS "end", 'S' || (turn_idx % 3) AS speaker
  FROM ref WHERE (CAST(rec_id AS BIGINT) + turn_idx) % 11 <> 0)"""
REGIONS = """raw AS (SELECT CAST(user_id AS VARCHAR) AS rec_id, event_id AS idx, floor(epoch_us(ts) / 600000000) / 8.0::DOUBLE - 213000 AS "start", value FROM events),
regions AS (SELECT rec_id, idx, "start", "start" + floor(value) / 8.0::DOUBLE AS "end" FROM raw)"""
MERGED = REGIONS + """,
padded AS (SELECT rec_id, greatest(0.0::DOUBLE, "start" - 0.25) AS "start", "end" + 0.25 AS "end" FROM regions),
marked AS (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY rec_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.3 THEN 0 ELSE 1 END AS n FROM padded),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM marked),
merged AS (SELECT rec_id, min("start") AS "start", max("end") AS "end" FROM numbered GROUP BY rec_id, g HAVING max("end") - min("start") >= 0.2)"""
SLICED = MERGED + """,
hops AS (SELECT *, greatest(0, CAST(ceil(("end" - "start" - 1.5) / 0.75) AS INTEGER)) AS n FROM merged),
cut AS (SELECT rec_id, "start" + k * 0.75::DOUBLE AS "start", "start" + k * 0.75::DOUBLE + 1.5 AS "end" FROM (SELECT *, unnest(range(n)) AS k FROM hops)
  UNION ALL SELECT rec_id, greatest("start", "end" - 1.5), "end" FROM hops),
windows AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY "start", "end") - 1 AS idx, "start", "end" FROM cut)"""
ASSIGNED = WORDS + ",\n" + TURNS + """,
pairs AS (SELECT w.*, t.speaker, t.turn_idx, t."start" AS ts, t."end" AS te, greatest(0.0, least(w."end", t."end") - greatest(w."start", t."start")) AS o,
  greatest(0.0, t."start" - w."end", w."start" - t."end") AS d FROM words w JOIN ref t ON w.rec_id = t.rec_id AND greatest(0.0, t."start" - w."end", w."start" - t."end") <= 1.0),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY rec_id, word_idx ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, ts, te, turn_idx) = 1),
assigned AS (SELECT w.*, b.speaker FROM words w LEFT JOIN best b USING (rec_id, word_idx))"""
GROUPED = ASSIGNED + """,
lagged AS (SELECT *, lag(speaker) OVER q AS ls, lag("end") OVER q AS le, row_number() OVER q AS rn FROM assigned WINDOW q AS (PARTITION BY rec_id ORDER BY word_idx)),
broken AS (SELECT *, sum(CASE WHEN rn > 1 AND speaker IS NOT DISTINCT FROM ls AND "start" - le <= 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY word_idx) - 1 AS seg_idx FROM lagged),
segments AS (SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, arg_min("start", word_idx) AS "start", arg_max("end", word_idx) AS "end", any_value(speaker) AS speaker,
  string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words FROM broken GROUP BY rec_id, seg_idx)"""
INTERVALS = TURNS + ",\n" + HYP + """,
rawholes AS (SELECT rec_id, unnest(["start", "end"]) - 0.25 AS "start", unnest(["start", "end"]) + 0.25 AS "end" FROM ref),
hm AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY rec_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM rawholes),
hn AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM hm),
holes AS (SELECT rec_id, min("start") AS "start", max("end") AS "end" FROM hn GROUP BY rec_id, g),
bounds AS (SELECT rec_id, "start" AS x FROM ref UNION SELECT rec_id, "end" FROM ref UNION SELECT rec_id, "start" FROM hyp UNION SELECT rec_id, "end" FROM hyp
  UNION SELECT rec_id, "start" FROM holes UNION SELECT rec_id, "end" FROM holes),
elementary AS (SELECT rec_id, x AS "start", lead(x) OVER (PARTITION BY rec_id ORDER BY x) AS "end" FROM bounds),
scored AS (SELECT rec_id, "start", "end", ("start" + "end") / 2 AS mid, "end" - "start" AS dur FROM elementary e WHERE "end" IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM holes h WHERE h.rec_id = e.rec_id AND h."start" < (e."start" + e."end") / 2 AND (e."start" + e."end") / 2 < h."end")
  AND EXISTS (SELECT 1 FROM (SELECT rec_id, "start", "end" FROM ref UNION ALL SELECT rec_id, "start", "end" FROM hyp) t WHERE t.rec_id = e.rec_id AND t."start" < (e."start" + e."end") / 2 AND (e."start" + e."end") / 2 < t."end")),
ra AS (SELECT s.rec_id, s."start", s.dur, t.speaker AS ref FROM scored s JOIN ref t ON t.rec_id = s.rec_id AND t."start" < mid AND mid < t."end"),
ha AS (SELECT s.rec_id, s."start", s.dur, t.speaker AS hyp FROM scored s JOIN hyp t ON t.rec_id = s.rec_id AND t."start" < mid AND mid < t."end"),
matrix AS (SELECT ra.rec_id, ref, hyp, sum(ra.dur) AS seconds FROM ra JOIN ha ON ra.rec_id = ha.rec_id AND ra."start" = ha."start" GROUP BY ALL)"""
DER = INTERVALS + """,
perm(k, r0, r1, r2) AS (VALUES (1, 'user', 'assistant', 'system'), (2, 'user', 'system', 'assistant'), (3, 'assistant', 'user', 'system'), (4, 'assistant', 'system', 'user'), (5, 'system', 'user', 'assistant'), (6, 'system', 'assistant', 'user')),
option AS (SELECT k, 'S0' AS hyp, r0 AS ref FROM perm UNION ALL SELECT k, 'S1', r1 FROM perm UNION ALL SELECT k, 'S2', r2 FROM perm),
gain AS (SELECT rec_id, k, sum(seconds) AS s FROM matrix JOIN option USING (hyp, ref) GROUP BY rec_id, k),
chosen AS (SELECT rec_id, arg_min(k, (-s, k)) AS k FROM gain GROUP BY rec_id),
mapping AS (SELECT rec_id, hyp, ref FROM chosen JOIN option USING (k) JOIN matrix USING (rec_id, hyp, ref)),
counts AS (SELECT rec_id, "start", max(dur) AS dur, sum(r) AS r, sum(h) AS h FROM (SELECT rec_id, "start", dur, 1 AS r, 0 AS h FROM ra UNION ALL SELECT rec_id, "start", dur, 0, 1 FROM ha) GROUP BY ALL),
sums AS (SELECT rec_id, sum(dur * r) AS total, sum(dur * greatest(0, r - h)) AS missed, sum(dur * greatest(0, h - r)) AS fa, sum(dur * least(r, h)) AS b FROM (SELECT rec_id, "start", dur::DOUBLE AS dur, r::BIGINT AS r, h::BIGINT AS h FROM counts) GROUP BY rec_id),
correct AS (SELECT ha.rec_id, sum(dur) AS c FROM ha JOIN mapping USING (rec_id, hyp) WHERE EXISTS (SELECT 1 FROM ra WHERE ra.rec_id = ha.rec_id AND ra."start" = ha."start" AND ra.ref = mapping.ref) GROUP BY ha.rec_id),
der AS (SELECT e.rec_id, coalesce(missed, 0) AS missed, coalesce(fa, 0) AS false_alarm, coalesce(b - coalesce(c, 0), 0) AS confusion, coalesce(total, 0) AS total_reference
  FROM (SELECT DISTINCT rec_id FROM ref) e LEFT JOIN sums USING (rec_id) LEFT JOIN correct USING (rec_id))"""
NORMAL = r"""norm AS (SELECT doc_id, list_filter(string_split(replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), '([a-z])''([a-z])', '\1#\2', 'g'), '([a-z])''([a-z])', '\1#\2', 'g'), '''', ' '), '#', ''''), ' '), lambda w: w <> '') AS ws FROM documents)"""
