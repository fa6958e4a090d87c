"""The driver queries of the engine's own operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise import functions as fn
from turnwise.operators import align, assign, cluster, mixture, score, sweep, timeline
from turnwise.plans import derive as d
from turnwise.sources import formats
from turnwise.streaming.live import track_speakers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return align.group_segments(align.assign_words(d.words(spark, sf), d.reference_turns(spark, sf)))


def _der(spark: SparkSession, sf: str) -> DataFrame:
    return score.der(d.reference_turns(spark, sf), d.hypothesis_turns(spark, sf), refs=("user", "assistant", "system"), hyps=("S0", "S1", "S2"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.merge_regions(d.regions(spark, sf), 0.3, 0.2, 0.25)


@query(f"WITH {d.ASSIGNED} SELECT rec_id, word_idx, \"start\", \"end\", text, speaker FROM assigned")
def assign_words(spark, sf):
    return align.assign_words(d.words(spark, sf), d.reference_turns(spark, sf)).select("rec_id", "word_idx", "start", "end", "text", "speaker")


@query(f"WITH {d.GROUPED} SELECT rec_id, seg_idx, \"start\", \"end\", speaker, text, n_words FROM segments")
def group_segments(spark, sf):
    return _segments(spark, sf).select("rec_id", "seg_idx", "start", "end", "speaker", "text", F.size("words").cast("bigint").alias("n_words"))


@query(f"WITH {d.MERGED} SELECT rec_id, \"start\", \"end\" FROM merged")
def merge_regions(spark, sf):
    return _merged(spark, sf)


@query(f"WITH {d.INTERVALS} SELECT rec_id, \"start\", \"end\" FROM holes")
def merge_intervals_collar(spark, sf):
    return timeline.collar_holes(d.reference_turns(spark, sf), 0.25)


@query(f"WITH {d.SLICED} SELECT rec_id, idx, \"start\", \"end\" FROM windows")
def slice_windows(spark, sf):
    return timeline.slice_windows(_merged(spark, sf))


@query(f"""WITH RECURSIVE {d.SLICED},
lw AS (SELECT rec_id, idx + 1 AS rn, "start", "end", CAST(floor("start" / 3) AS BIGINT) % 3 AS label FROM windows),
f AS (SELECT rec_id, rn, "start" AS cs, "end" AS ce, label AS cl, NULL::DOUBLE AS ds, NULL::DOUBLE AS de, NULL::BIGINT AS dl FROM lw WHERE rn = 1
  UNION ALL
  SELECT f.rec_id, w.rn,
    CASE WHEN w.label = cl AND w."start" - ce <= 0.5 THEN cs WHEN w."start" < ce THEN (w."start" + ce) / 2 ELSE w."start" END,
    CASE WHEN w.label = cl AND w."start" - ce <= 0.5 THEN greatest(ce, w."end") WHEN w."start" < ce THEN greatest((w."start" + ce) / 2, w."end") ELSE greatest(w."start", w."end") END,
    w.label,
    CASE WHEN w.label = cl AND w."start" - ce <= 0.5 THEN NULL ELSE cs END,
    CASE WHEN w.label = cl AND w."start" - ce <= 0.5 THEN NULL WHEN w."start" < ce THEN (w."start" + ce) / 2 ELSE ce END,
    CASE WHEN w.label = cl AND w."start" - ce <= 0.5 THEN NULL ELSE cl END
  FROM f JOIN lw w ON w.rec_id = f.rec_id AND w.rn = f.rn + 1),
t AS (SELECT rec_id, ds AS "start", de AS "end", dl AS label FROM f WHERE ds IS NOT NULL
  UNION ALL SELECT rec_id, arg_max(cs, rn), max_by(ce, rn), max_by(cl, rn) FROM f GROUP BY rec_id)
SELECT rec_id, "start", "end", printf('SPEAKER_%02d', label) AS speaker FROM t WHERE "end" > "start" """)
def windows_to_turns(spark, sf):
    turns = timeline.windows_to_turns(d.labelled_windows(timeline.slice_windows(_merged(spark, sf))))
    return turns.select("rec_id", "start", "end", fn.speaker_label(F.col("label")).alias("speaker"))


@query(f"WITH {d.INTERVALS} SELECT rec_id, \"start\", \"end\" FROM elementary WHERE \"end\" IS NOT NULL")
def elementary_intervals(spark, sf):
    r, h = d.reference_turns(spark, sf), d.hypothesis_turns(spark, sf)
    spans = r.select("rec_id", "start", "end").unionByName(h.select("rec_id", "start", "end")).unionByName(timeline.collar_holes(r, 0.25))
    return timeline.elementary_intervals(spans.select("rec_id", F.explode(F.array("start", "end")).alias("x")))


@query(f"""WITH {d.INTERVALS}, b AS (SELECT rec_id, "start" AS x FROM ref UNION SELECT rec_id, "end" FROM ref UNION SELECT rec_id, "start" FROM holes UNION SELECT rec_id, "end" FROM holes),
e AS (SELECT rec_id, x AS "start", lead(x) OVER (PARTITION BY rec_id ORDER BY x) AS "end" FROM b)
SELECT rec_id, "start", "end" FROM e WHERE "end" IS NOT NULL
  AND EXISTS (SELECT 1 FROM ref t WHERE t.rec_id = e.rec_id AND t."start" < (e."start" + e."end") / 2 AND (e."start" + e."end") / 2 < t."end")
  AND NOT EXISTS (SELECT 1 FROM holes t WHERE t.rec_id = e.rec_id AND t."start" < (e."start" + e."end") / 2 AND (e."start" + e."end") / 2 < t."end")""")
def interval_subtract(spark, sf):
    r = d.reference_turns(spark, sf)
    return timeline.subtract(r, timeline.collar_holes(r, 0.25))


@query(f"WITH {d.INTERVALS} SELECT s.rec_id, s.\"start\", s.\"end\", count(ref) AS n_ref, coalesce(string_agg(ref, ',' ORDER BY ref), '') AS refs FROM scored s LEFT JOIN ra ON ra.rec_id = s.rec_id AND ra.\"start\" = s.\"start\" GROUP BY ALL")
def stab_active(spark, sf):
    r, h = d.reference_turns(spark, sf), d.hypothesis_turns(spark, sf)
    parts = score.scored_intervals(r, h)
    held = timeline.stab(parts, r.select("rec_id", "start", "end", "speaker"), how="left")
    return held.groupBy("rec_id", "start", "end").agg(F.count("_s_speaker").alias("n_ref"), F.array_join(F.array_sort(F.collect_list("_s_speaker")), ",").alias("refs"))


@query(f"WITH {d.INTERVALS} SELECT rec_id, ref, hyp, seconds FROM matrix")
def overlap_matrix(spark, sf):
    r, h = d.reference_turns(spark, sf), d.hypothesis_turns(spark, sf)
    return score.overlap_matrix(score.scored_intervals(r, h), r, h)


@query(f"WITH {d.DER} SELECT rec_id, missed, false_alarm, confusion, total_reference, CASE WHEN total_reference > 0 THEN round((missed + false_alarm + confusion) / total_reference, 9) ELSE 'NaN'::DOUBLE END AS der FROM der")
def der_components(spark, sf):
    return _der(spark, sf).select("rec_id", "missed", "false_alarm", "confusion", "total_reference", F.round("der", 9).alias("der"))


@query(f"WITH {d.DER} SELECT round(sum(missed + false_alarm + confusion) / sum(total_reference), 9) AS der, round(sum(missed) / sum(total_reference), 9) AS missed, round(sum(false_alarm) / sum(total_reference), 9) AS false_alarm, round(sum(confusion) / sum(total_reference), 9) AS confusion FROM der")
def der_pooled(spark, sf):
    s = score.pooled_der(_der(spark, sf))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query(f"WITH {d.NORMAL} SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, ' ') AS words FROM norm")
def normalize_text(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", fn.normalize_words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join("w", " ").alias("words"))


# cells of an anti-diagonal: v packs cost, substitutions, deletions, insertions; prev is the cell to the left
# whole texts are too long for an edit table in SQL; tests compare with a plain one
@query()
def wer_counts(spark, sf):
    w = score.wer_counts(d.wer_pairs(spark, sf))
    return w.select("doc_id", "substitutions", "deletions", "insertions", "reference_words", F.round("wer", 9).alias("wer"))


@query()
def wer_pooled(spark, sf):
    return score.pooled_wer(score.wer_counts(d.wer_pairs(spark, sf))).select(F.round("wer", 9).alias("wer"))


_CELLS = """recs AS (SELECT rec_id, row_number() OVER (ORDER BY CAST(rec_id AS BIGINT)) - 1 AS mix_idx FROM (SELECT DISTINCT rec_id FROM ref)),
vals AS (SELECT unnest(range(9)) AS k),
tot AS (SELECT rec_id, sum("end" - "start") AS ref_time, count(*) AS n, count(DISTINCT speaker) AS spk FROM ref GROUP BY rec_id),
cells AS (SELECT rec_id, mix_idx, printf('%.2f', k * 0.05) AS value, CASE WHEN mix_idx % 2 = 0 THEN 'calibration' ELSE 'heldout' END AS split,
  ((mix_idx * 3 + k * 5) % 7) / 8.0::DOUBLE AS miss, ((mix_idx + k) % 5) / 4.0::DOUBLE AS false_alarm, ((mix_idx + k * k) % 3) / 2.0::DOUBLE AS confusion, ref_time, spk AS r, spk + CASE WHEN (mix_idx + k) % 4 = 0 THEN 1 ELSE 0 END AS h
  FROM recs JOIN tot USING (rec_id) CROSS JOIN vals),
rolled AS (SELECT value, coalesce(split, 'all') AS split, round(sum(miss + false_alarm + confusion) / sum(ref_time), 9) AS der, round(sum(miss) / sum(ref_time), 9) AS miss, round(sum(false_alarm) / sum(ref_time), 9) AS false_alarm,
  round(sum(confusion) / sum(ref_time), 9) AS confusion, count(*) FILTER (r = h) || '/' || count(*) AS speakers_correct, count(*) AS recordings FROM cells GROUP BY GROUPING SETS ((value, split), (value)))"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    r = d.reference_turns(spark, sf)
    tot = r.groupBy("rec_id").agg(F.sum(F.col("end") - F.col("start")).alias("ref_time"), F.count_distinct("speaker").alias("num_speakers_ref"))
    mix = sweep.numbered(tot.withColumn("n", F.col("rec_id").cast("bigint")), "n", "mix_idx").select("rec_id", "ref_time", "num_speakers_ref", "mix_idx")
    c = mix.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    m, k = F.col("mix_idx"), F.col("k")
    c = c.select("rec_id", "mix_idx", F.format_string("%.2f", k * F.lit(0.05)).alias("value"), ((m * 3 + k * 5) % 7 / F.lit(8.0)).alias("miss"), ((m + k) % 5 / F.lit(4.0)).alias("false_alarm"), ((m + k * k) % 3 / F.lit(2.0)).alias("confusion"), "ref_time", "num_speakers_ref", (F.col("num_speakers_ref") + F.when((m + k) % 4 == 0, 1).otherwise(0)).alias("num_speakers_hyp"))
    return sweep.with_split(c)


@query(f"WITH {d.TURNS}, {_CELLS} SELECT * FROM rolled")
def grid_rollup(spark, sf):
    rolled = sweep.roll_up(_cells(spark, sf))
    return rolled.select("value", "split", *[F.round(c, 9).alias(c) for c in ("der", "miss", "false_alarm", "confusion")], "speakers_correct", "recordings")


@query(f"WITH {d.TURNS}, {_CELLS} SELECT value, der FROM rolled WHERE split = 'calibration' ORDER BY der, value LIMIT 1")
def pick_value(spark, sf):
    return sweep.pick_value(sweep.roll_up(_cells(spark, sf))).select("value", F.round("der", 9).alias("der"))


@query(f"WITH {d.TURNS}, {_CELLS} SELECT rec_id, mix_idx, split FROM cells WHERE value = '0.00'")
def even_odd_split(spark, sf):
    return _cells(spark, sf).where("value = '0.00'").select("rec_id", "mix_idx", "split").withColumn("mix_idx", F.col("mix_idx").cast("bigint"))


@query(f"WITH {d.TURNS}, {d.HYP}, n AS (SELECT r.rec_id, r.n AS n_ref, coalesce(h.n, 0) AS n_hyp FROM (SELECT rec_id, count(DISTINCT speaker) AS n FROM ref GROUP BY 1) r LEFT JOIN (SELECT rec_id, count(DISTINCT speaker) AS n FROM hyp GROUP BY 1) h USING (rec_id)) SELECT rec_id, n_ref, n_hyp, n_ref = n_hyp AS correct FROM n")
def speaker_count(spark, sf):
    n = lambda t, c: t.groupBy("rec_id").agg(F.count_distinct("speaker").alias(c))
    both = n(d.reference_turns(spark, sf), "n_ref").join(n(d.hypothesis_turns(spark, sf), "n_hyp"), "rec_id", "left").withColumn("n_hyp", F.coalesce("n_hyp", F.lit(0)))
    return both.withColumn("correct", F.col("n_ref") == F.col("n_hyp"))


@query(f"WITH {d.TURNS}, l AS (SELECT rec_id, greatest(0.0, lag(\"end\") OVER (PARTITION BY rec_id ORDER BY \"start\", \"end\", turn_idx) - \"start\") AS o FROM ref) SELECT rec_id, coalesce(sum(o), 0.0)::DOUBLE AS overlapped_seconds FROM l GROUP BY rec_id")
def consecutive_overlap(spark, sf):
    return timeline.consecutive_overlap(d.reference_turns(spark, sf))


@query("WITH a AS (SELECT CAST(vec_id % 7 AS VARCHAR) AS rec_id, vec_id AS idx, label FROM embeddings), f AS (SELECT *, min(idx) OVER (PARTITION BY rec_id, label) AS f FROM a) SELECT rec_id, idx, CAST(dense_rank() OVER (PARTITION BY rec_id ORDER BY f) - 1 AS INTEGER) AS label FROM f")
def relabel_first_appearance(spark, sf):
    e = d.table(spark, sf, "embeddings").select((F.col("vec_id") % 7).cast("string").alias("rec_id"), F.col("vec_id").alias("idx"), "label")
    return cluster.relabel_first_appearance(e)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 5) AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label AND a.vec_id % 50 = 0 AND (a.vec_id < b.vec_id OR a.vec_id > b.vec_id AND b.vec_id % 50 <> 0)")
def pairwise_cosine(spark, sf):
    return cluster.cosine_to_queries(d.vectors(spark, sf), 50, 5)


_CENTROIDS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i), q AS (SELECT label, sqrt(sum(m * m)) AS q FROM m GROUP BY label),
cen AS (SELECT label, i, m / CASE WHEN q > 0 THEN q ELSE 1 END AS c FROM m JOIN q USING (label))"""


@query(f"WITH {_CENTROIDS} SELECT CAST(label AS VARCHAR) AS rec_id, CAST(i AS INTEGER) AS i, round(c, 6) AS c FROM cen")
def centroid_by_label(spark, sf):
    c = cluster.centroids(d.vectors(spark, sf), "rec_id")
    return c.select("rec_id", F.posexplode("centroid").alias("i", "c")).select("rec_id", "i", F.round("c", 6).alias("c"))


@query(f"WITH {_CENTROIDS}, s AS (SELECT x.vec_id, cen.label, 1 - sum(v * c) / sqrt(sum(v * v)) AS dist FROM x JOIN cen USING (i) GROUP BY ALL) SELECT vec_id, CAST(arg_min(label, (round(dist, 6), label)) AS VARCHAR) AS nearest, round(min(dist), 5) AS distance FROM s GROUP BY vec_id")
def nearest_centroid(spark, sf):
    v = d.vectors(spark, sf)
    # one row of all centroids (one a label), as a scalar subquery
    c = cluster.centroids(v, "rec_id").select(F.col("rec_id").cast("int").alias("label"), "centroid")
    cs = c.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("cs")).scalar()
    distance = lambda x: fn.cosine_distance(F.col("vec"), x["centroid"])
    s = v.withColumn("cs", cs).select("idx", F.transform("cs", lambda x: F.struct(F.round(distance(x), 6).alias("d"), x["label"].alias("label"), distance(x).alias("e"))).alias("ds"))
    return s.select(F.col("idx").alias("vec_id"), F.array_min("ds")["label"].cast("string").alias("nearest"), F.round(F.array_min(F.transform("ds", lambda x: x["e"])), 5).alias("distance"))


_STAMP = "printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"


@query(f"WITH {d.GROUPED}, n AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS n, CAST(round_even(\"start\" * 1000, 0) AS BIGINT) AS a, CAST(round_even(\"end\" * 1000, 0) AS BIGINT) AS b, speaker, text FROM segments) SELECT rec_id, CAST(n AS INTEGER) AS n, n || chr(10) || {_STAMP.replace('ms', 'a')} || ' --> ' || {_STAMP.replace('ms', 'b')} || chr(10) || coalesce(speaker || ': ', '') || text AS block FROM n")
def srt_blocks(spark, sf):
    return formats.srt_blocks(_segments(spark, sf))


@query(f"WITH {d.TURNS} SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY \"start\", turn_idx) AS INTEGER) AS n, 'SPEAKER ' || rec_id || ' 1 ' || printf('%.3f', \"start\") || ' ' || printf('%.3f', \"end\" - \"start\") || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS line FROM ref")
def rttm_lines(spark, sf):
    return formats.rttm_lines(d.reference_turns(spark, sf))


@query(f"WITH {d.GROUPED} SELECT rec_id, count(*) AS n_segments, sum(n_words)::BIGINT AS n_words, sum(length(text))::BIGINT AS text_chars FROM segments GROUP BY rec_id")
def segments_json(spark, sf):
    """The written JSON, read again."""
    from turnwise.schema import TRANSCRIPT

    j = formats.segments_to_json(_segments(spark, sf)).select("rec_id", F.from_json("json", TRANSCRIPT).alias("t"))
    total = lambda f: F.aggregate("t.segments", F.lit(0).cast("bigint"), lambda a, s: a + f(s).cast("bigint"))
    return j.select("rec_id", F.size("t.segments").cast("bigint").alias("n_segments"), total(lambda s: F.size(s["words"])).alias("n_words"), total(lambda s: F.char_length(s["text"])).alias("text_chars"))


@query("SELECT role AS speaker, CAST(conv_id AS VARCHAR) AS rec_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) <= 9")
def limit_per_speaker(spark, sf):
    c = d.table(spark, sf, "conversations")
    rank = F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))
    return c.withColumn("n", rank).where("n <= 9").select(F.col("role").alias("speaker"), F.col("conv_id").cast("string").alias("rec_id"), "turn")


@query("SELECT CAST(conv_id AS VARCHAR) AS rec_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def reference_text(spark, sf):
    c = d.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return c.select(F.col("conv_id").cast("string").alias("rec_id"), "text")


_OVER = """o AS (SELECT r.rec_id, r.speaker AS ref, h.speaker AS hyp, sum(least(r."end", h."end") - greatest(r."start", h."start")) AS seconds FROM ref r JOIN hyp h ON r.rec_id = h.rec_id AND r."start" < h."end" AND h."start" < r."end" GROUP BY ALL),
g1 AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY seconds DESC, hyp, ref) = 1),
o2 AS (SELECT o.* FROM o JOIN g1 ON o.rec_id = g1.rec_id AND o.ref <> g1.ref AND o.hyp <> g1.hyp),
g2 AS (SELECT * FROM o2 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY seconds DESC, hyp, ref) = 1),
o3 AS (SELECT o2.* FROM o2 JOIN g2 ON o2.rec_id = g2.rec_id AND o2.ref <> g2.ref AND o2.hyp <> g2.hyp),
g3 AS (SELECT * FROM o3 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY seconds DESC, hyp, ref) = 1),
greedy AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)"""


@query(f"WITH {d.TURNS}, {d.HYP}, {_OVER} SELECT rec_id, hyp, ref, seconds FROM greedy")
def greedy_speaker_map(spark, sf):
    return assign.greedy_mapping(assign.turn_overlaps(d.reference_turns(spark, sf), d.hypothesis_turns(spark, sf)))


@query(f"WITH {d.TURNS}, {d.HYP}, {_OVER} SELECT rec_id, speaker FROM ref EXCEPT SELECT rec_id, ref FROM greedy")
def orphan_speakers(spark, sf):
    r = d.reference_turns(spark, sf)
    return assign.orphan_speakers(r, greedy_speaker_map(spark, sf))


@query(f"WITH {d.TURNS}, t AS (SELECT rec_id, sum(\"end\" - \"start\") AS dur, count(*) / 64.0::DOUBLE AS sec FROM ref GROUP BY rec_id) SELECT round(avg(CASE WHEN dur > 0 THEN sec / dur ELSE 'NaN'::DOUBLE END), 6) AS mean_rtf FROM t")
def rtf(spark, sf):
    t = d.reference_turns(spark, sf).groupBy("rec_id").agg(F.sum(F.col("end") - F.col("start")).alias("dur"), (F.count(F.lit(1)) / F.lit(64.0)).alias("sec"))
    return t.agg(F.round(F.avg(fn.real_time_factor(F.col("sec"), F.col("dur"))), 6).alias("mean_rtf"))


@query("WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS rec_id, turn AS idx, role AS speaker, length(text) / 16.0::DOUBLE AS seconds, (turn % 4 + 1) / 8.0::DOUBLE AS gap FROM conversations), p AS (SELECT *, coalesce(sum(seconds + gap) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u) SELECT rec_id, idx, s AS \"start\", s + seconds AS \"end\", speaker FROM p")
def place_utterances(spark, sf):
    c = d.table(spark, sf, "conversations")
    return timeline.place_utterances(c.select(F.col("conv_id").cast("string").alias("rec_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), (F.char_length("text") / F.lit(16.0)).alias("seconds"), ((F.col("turn") % 4 + 1) / F.lit(8.0)).alias("gap")))


@query("SELECT CAST(conv_id AS VARCHAR) AS rec_id, CAST(floor(max(turn * 40) / 60) AS BIGINT) || ':' || lpad(CAST(max(turn * 40) % 60 AS VARCHAR), 2, '0') AS clock, greatest(max(turn * 40.0::DOUBLE), 1.0) AS extent FROM conversations GROUP BY conv_id")
def timeline_extent(spark, sf):
    c = d.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.col("turn") * 40).cast("double").alias("t"))
    return c.select(F.col("conv_id").cast("string").alias("rec_id"), fn.clock(F.col("t")).alias("clock"), F.greatest("t", F.lit(1.0)).alias("extent"))


@query(f"WITH {d.WORDS} SELECT rec_id, arg_min(text, word_idx) AS text FROM words WHERE \"start\" <= 40.125 AND \"end\" > 40.125 GROUP BY rec_id")
def word_at_position(spark, sf):
    return align.word_at(d.words(spark, sf), 40.125).select("rec_id", "text")


@query()
def cluster_embeddings(spark, sf):
    return cluster.cluster_embeddings(d.vectors(spark, sf), 0.75)


@query()
def online_tracker(spark, sf):
    v = d.vectors(spark, sf).select(F.col("rec_id").alias("session"), F.floor(F.col("idx") / 64).cast("bigint").alias("chunk"), "idx", "vec", F.pmod("idx", F.lit(3)).cast("int").alias("local_label"))
    return track_speakers(v, 0.9)


def _utterances(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "conversations")
    samples = F.transform(F.sequence(F.lit(0), F.char_length("text") + 100), lambda i: ((i * 37 + F.col("turn")) % 64 / F.lit(64.0)).cast("float"))
    return c.select(F.col("conv_id").cast("string").alias("rec_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), F.col("text").alias("transcript"), F.lit(1000).alias("sample_rate"), samples.alias("samples"))


@query()
def interleave_speakers(spark, sf):
    return mixture.interleave_speakers(_utterances(spark, sf)).select("rec_id", "idx", "speaker")


@query()
def build_mixture(spark, sf):
    m = mixture.build_mixture(_utterances(spark, sf), overlap_prob=0.5, gap_range=(0.05, 0.1), overlap_range=(0.02, 0.05))
    return m.select("rec_id", F.round("duration", 6).alias("duration"), F.size("turns").alias("n_turns"), F.round(fn.peak(F.col("samples")).cast("double"), 6).alias("peak"))
