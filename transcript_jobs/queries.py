"""One query per operator over the given tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions import citations as C
from transcript_jobs.functions import summary_json as J
from transcript_jobs.functions import text as T
from transcript_jobs.jobs import flows
from transcript_jobs.operators import chat, chunking, index, models, quality, questions, retrieval, segments, summaries
from transcript_jobs.sources import tables
from transcript_jobs.sources import testdata as D

#: name -> (query, SQL or None)
REGISTERED: dict = {}
SMALL_CAP, SMALL_CHUNK, SMALL_RANK = 5, 50, 3
AGREEMENT_SLICE = 600.0


def register(name: str, sql: str | None = None):
    def add(f):
        REGISTERED[name] = (f, sql)
        return f

    return add


def _sql_any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _of(template: str, column: str) -> str:
    return template.replace("{c}", column)


# A word boundary of any script: the SQL engine's own knows ASCII only.
_B = r"(?:$|[^\p{L}\p{N}_])"
_FILLER = rf"(?i)^\s*{_sql_any(P.FILLER_OPENERS)}?[,\s]*{_sql_any(P.FILLERS)}\s*\??\s*$".replace("'", "''")
_CLAUSE = rf"(?i)(?:^|[.!?]\s+|,\s*)(?:{_sql_any(P.LEAD_INS)}\s+)?{_sql_any(P.INTERROGATIVES)}{_B}"
_SENTENCES = r"list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s))"
_FLAG = (
    f"len(list_filter({_SENTENCES}, lambda s: s <> '' AND NOT regexp_matches(s, '{_FILLER}') "
    f"AND (contains(s, '?') OR regexp_matches(s, '{_CLAUSE}')))) > 0"
)
_WORDS = "len(list_filter(string_split(regexp_replace({c}, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''))"
_WINDOWS = f"""
flagged AS (
  SELECT *, {_of(_FLAG, "text")} AS flag FROM segments
), near AS (
  SELECT *, lag(flag) OVER o AS flag_before, lag("end") OVER o AS end_before, lag(text) OVER o AS text_before, lead(text) OVER o AS text_after
  FROM flagged WINDOW o AS (PARTITION BY video_id ORDER BY seg_idx)
), runs AS (
  SELECT *, sum(CASE WHEN flag AND (NOT coalesce(flag_before, false) OR start - end_before > 2.0) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY seg_idx) AS run
  FROM near
), windows AS (
  SELECT video_id, min(seg_idx)::INT AS segment_index, arg_min(start, seg_idx) AS start, arg_max("end", seg_idx) AS "end",
         concat_ws(' ', first(text_before ORDER BY seg_idx), string_agg(text, ' ' ORDER BY seg_idx), last(text_after ORDER BY seg_idx)) AS text
  FROM runs WHERE flag GROUP BY video_id, run
)"""
_CLOCK = """(CASE WHEN {s} >= 3600 THEN ({s}::BIGINT // 3600)::VARCHAR || ':' || lpad(({s}::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s}::BIGINT % 60)::VARCHAR, 2, '0')
  ELSE lpad(({s}::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad(({s}::BIGINT % 60)::VARCHAR, 2, '0') END)"""


def _stamp(c: str) -> str:
    return _CLOCK.format(s=f"floor({c})")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.clean_segments(D.segments(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str, most: int = P.CHUNK_WORDS) -> DataFrame:
    return chunking.chunk_segments(_clean(spark, sf_dir), most)


def _chunk_sql(most: int) -> str:
    return f"""
sized AS (
  SELECT *, len(string_split(text, ' ')) AS n FROM segments
), walk AS (
  SELECT video_id, seg_idx, n, CASE WHEN n > {most} THEN ceil(n / {most})::INT ELSE 1 END AS last, 1 AS first, CASE WHEN n > {most} THEN 0 ELSE n END AS open
  FROM sized WHERE seg_idx = 0
  UNION ALL
  SELECT s.video_id, s.seg_idx, s.n,
         CASE WHEN s.n > {most} THEN w.last + ceil(s.n / {most})::INT WHEN w.open > 0 AND w.open + s.n <= {most} THEN w.last ELSE w.last + 1 END,
         CASE WHEN s.n <= {most} AND w.open > 0 AND w.open + s.n <= {most} THEN w.last ELSE w.last + 1 END,
         CASE WHEN s.n > {most} THEN 0 WHEN w.open > 0 AND w.open + s.n <= {most} THEN w.open + s.n ELSE s.n END
  FROM walk w JOIN sized s ON s.video_id = w.video_id AND s.seg_idx = w.seg_idx + 1
), whole AS (
  SELECT s.video_id, w.last AS chunk_id, arg_min(start, s.seg_idx) AS start, arg_max("end", s.seg_idx) AS "end", string_agg(text, ' ' ORDER BY s.seg_idx) AS text, sum(s.n) AS word_count
  FROM walk w JOIN sized s USING (video_id, seg_idx) WHERE s.n <= {most} GROUP BY s.video_id, w.last
), pieces AS (
  SELECT s.video_id, w.first, start, "end", s.n, string_split(text, ' ') AS ws, unnest(range(0, s.n, {most})) AS i
  FROM walk w JOIN sized s USING (video_id, seg_idx) WHERE s.n > {most}
), chunks AS (
  SELECT video_id, chunk_id::INT AS chunk_id, start, "end", text, word_count::INT AS word_count FROM whole
  UNION ALL
  SELECT video_id, (first + i // {most})::INT, start + ("end" - start) * (i / n), start + ("end" - start) * (least(i + {most}, n) / n),
         array_to_string(ws[i + 1 : i + {most}], ' '), least({most}, n - i)::INT FROM pieces
)"""


_SEG = f"WITH {D.SEGMENTS}"
_REC = f"WITH RECURSIVE {D.SEGMENTS}"


# --- sources ---------------------------------------------------------------------------------------------------


@register(
    "explode_segments",
    f"""{_SEG}
SELECT video_id, pos::INT AS pos, CASE WHEN pos % 17 <> 5 THEN start END AS start, CASE WHEN pos % 17 NOT IN (5, 6) THEN "end" END AS "end",
       CASE WHEN pos % 17 NOT IN (5, 7) THEN text END AS text,
       CASE pos % 17 WHEN 5 THEN 'not an object' WHEN 6 THEN 'bad times' WHEN 7 THEN 'bad text' END AS reason
FROM raw_segments""",
)
def explode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON, one object a video, some of its elements of wrong types: parsed, typed and told apart."""
    s, p = D.segments(spark, sf_dir), F.col("pos") % 17
    one = F.to_json(F.struct("start", "end", "text"))
    one = (
        F.when(p == 5, F.lit("7"))
        .when(p == 6, F.to_json(F.struct("start", F.lit(True).alias("end"), "text")))
        .when(p == 7, F.to_json(F.struct("start", "end", F.lit(3).alias("text"))))
        .otherwise(one)
    )
    parts = F.array_sort(F.collect_list(F.struct("pos", one.alias("j"))))
    body = F.array_join(F.transform("p", lambda x: x["j"]), ",")
    raw = s.groupBy("video_id").agg(parts.alias("p")).select("video_id", F.concat(F.lit('{"segments":['), body, F.lit("]}")).alias("raw"))
    return tables.explode_segments(raw)


def _video_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = D.videos(spark, sf_dir)
    fresh = v.filter("doc_id % 4 < 2").withColumn("title", F.concat(F.lit("new "), "title")).withColumn("updated_at", F.timestamp_seconds(F.col("doc_id") + 1000))
    return v.filter("doc_id % 4 > 0"), fresh


@register(
    "upsert_videos",
    f"""WITH {D.VIDEOS}
SELECT video_id, CASE WHEN doc_id % 4 < 2 THEN 'new ' || title ELSE title END AS title, CASE WHEN doc_id % 4 < 2 THEN 'processing' ELSE status END AS status,
       coalesce(CASE WHEN doc_id % 4 > 0 THEN version END, -1) AS version, (CASE WHEN doc_id % 4 = 0 THEN doc_id + 1000 ELSE doc_id END)::BIGINT AS created_s
FROM videos""",
)
def upsert_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _video_halves(spark, sf_dir)
    out = tables.upsert_videos(old, new)
    return out.select("video_id", "title", "status", F.coalesce("summary.version", F.lit(-1)).alias("version"), F.unix_timestamp("created_at").alias("created_s"))


@register(
    "replace_for_videos",
    f"""{_REC}, {_chunk_sql(P.CHUNK_WORDS)}, old AS (SELECT * FROM chunks), again AS (
  SELECT video_id, seg_idx + 1 AS chunk_id, text FROM segments WHERE substr(video_id, 4)::INT % 3 = 0
)
SELECT video_id, chunk_id, text FROM old WHERE video_id NOT IN (SELECT video_id FROM again) UNION ALL SELECT * FROM again""",
)
def replace_for_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every third video replaced by its segments."""
    third = F.substring("video_id", 4, 8).cast("int") % 3 == 0
    new = _clean(spark, sf_dir).filter(third).select("video_id", (F.col("seg_idx") + 1).alias("chunk_id"), "text")
    return tables.replace_for_videos(_chunks(spark, sf_dir).select("video_id", "chunk_id", "text"), new, new)


# --- segments --------------------------------------------------------------------------------------------------


@register("clean_segments", f"{_SEG} SELECT * FROM segments")
def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir)


@register(
    "rejected_segments",
    f"""{_SEG}, r AS (
  SELECT video_id, CASE WHEN start < 0 OR "end" < 0 THEN 'negative time' WHEN "end" < start THEN 'ends before it starts' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty text' END AS reason
  FROM raw_segments
)
SELECT video_id, reason, count(*) AS dropped FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
)
def rejected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.rejected_segments(D.segments(spark, sf_dir))


@register(
    "transcript_status",
    f"""{_SEG}, e AS (
  SELECT 'vid' || lpad(doc_id::VARCHAR, 8, '0') AS video_id,
         CASE WHEN doc_id % 97 = 96 THEN '{P.BAD_TRANSCRIPT}' WHEN 'vid' || lpad(doc_id::VARCHAR, 8, '0') NOT IN (SELECT video_id FROM segments) THEN '{P.NO_SEGMENTS}' END AS error
  FROM documents
)
SELECT video_id, error IS NULL AS success, error FROM e""",
)
def transcript_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.transcript_status(D.transcripts(spark, sf_dir), _clean(spark, sf_dir))


@register("full_text", f"{_SEG} SELECT video_id, string_agg(text, ' ' ORDER BY seg_idx) AS full_text FROM segments GROUP BY video_id")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.full_text(_clean(spark, sf_dir))


@register(
    "fixed_windows",
    f"""{_SEG}, d AS (SELECT video_id, max("end") AS duration FROM segments GROUP BY video_id), w AS (
  SELECT video_id, duration, unnest(range(0, ceil(duration / 30)::BIGINT)) AS n FROM d
)
SELECT video_id, n::INT AS n, n * 30.0::DOUBLE AS start, least(duration, (n + 1) * 30.0::DOUBLE) AS "end" FROM w""",
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fixed_windows(_clean(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("duration")))


for _most in (P.CHUNK_WORDS, SMALL_CHUNK):
    register(f"chunk_segments_{_most}", f"{_REC}, {_chunk_sql(_most)} SELECT video_id, chunk_id, round(start, 6) AS start, round(\"end\", 6) AS \"end\", text, word_count FROM chunks")(
        lambda spark, sf_dir, most=_most: _chunks(spark, sf_dir, most).withColumn("start", F.round("start", 6)).withColumn("end", F.round("end", 6))
    )


# --- questions -------------------------------------------------------------------------------------------------


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.question_windows(_clean(spark, sf_dir))


@register("segment_has_candidate", f"{_SEG} SELECT video_id, seg_idx, {_of(_FLAG, 'text')} AS flag, regexp_matches(text, '{_FILLER}') AS filler FROM segments")
def segment_has_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("video_id", "seg_idx", T.segment_has_candidate(F.col("text")).alias("flag"), T.is_pure_filler(F.col("text")).alias("filler"))


@register("question_windows", f"{_SEG}, {_WINDOWS} SELECT * FROM windows")
def question_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


_CAP = f"""{_WINDOWS}, capped AS (
  SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY contains(text, '?') DESC, segment_index) <= {SMALL_CAP}
)"""


@register("cap_candidates", f"{_SEG}, {_CAP} SELECT * FROM capped")
def cap_candidates(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    return questions.cap_candidates(_windows(spark, sf_dir), cap)


@register(
    "question_prompts",
    f"""{_SEG}, {_CAP} SELECT video_id, segment_index, 2 AS n_messages, 'Transcript excerpt:' || chr(10) || chr(10) || text AS user_message FROM capped""",
)
def question_prompts(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    q = questions.question_prompts(cap_candidates(spark, sf_dir, cap))
    return q.select("video_id", "segment_index", F.size("messages").alias("n_messages"), F.col("messages")[1]["content"].alias("user_message"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z'']+')), lambda w: len(w) > 2 AND NOT list_contains(" + _STOPS + ", w))"
_ANSWERED = rf"""answered AS (
  SELECT *, coalesce(list_filter({_of(_SENTENCES, "text")}, lambda s: s LIKE '%?')[1], 'NONE') AS output FROM capped
), asked AS (
  SELECT *, regexp_replace(output, '\s+', ' ', 'g') AS bare FROM answered WHERE NOT starts_with(upper(output), 'NONE') AND NOT regexp_matches(output, '(?i)[()]|not an exact question|this assumes|is not (?:just )?stat(?:ed|ing)')
), question AS (
  SELECT video_id, segment_index, start, "end", text, upper(left(bare, 1)) || substr(bare, 2) AS question FROM asked
), accepted AS (
  SELECT *, {_of(_CONTENT, "question")} AS qw, {_of(_CONTENT, "text")} AS tw FROM question
  WHERE {_of(_WORDS, "question")} BETWEEN 3 AND 40 AND NOT regexp_matches(question, '{_FILLER}')
), grounded AS (
  SELECT video_id, segment_index, start, "end", question FROM accepted WHERE len(qw) > 0 AND len(list_intersect(qw, tw)) / len(qw) >= 0.5
)"""


def _accepted(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    prompts = questions.question_prompts(cap_candidates(spark, sf_dir, cap))
    out = models.generate_column(prompts, "messages", models.FirstQuestionGenerator(), batch_size=P.VALIDATION_BATCH)
    return questions.accept_questions(out).select("video_id", "segment_index", "start", "end", "question")


@register("accept_questions", f"{_SEG}, {_CAP}, {_ANSWERED} SELECT * FROM grounded")
def accept_questions(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    return _accepted(spark, sf_dir, cap)


_SCORE = f"""({_of(_WORDS, "rtrim(question, '?')")} + CASE WHEN list_contains([{", ".join(f"'{w}'" for w in P.CONCEPTUAL)}], lower(string_split(rtrim(question, '?'), ' ')[1])) THEN 5 ELSE 0 END)"""


@register(
    "rank_questions",
    f"{_SEG}, {_CAP}, {_ANSWERED} SELECT * FROM grounded QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {_SCORE} DESC, start, segment_index) <= {SMALL_RANK}",
)
def rank_questions(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP, rank: int = SMALL_RANK) -> DataFrame:
    return questions.rank_questions(_accepted(spark, sf_dir, cap), rank)


_GREEDY = r"""q AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, segment_index) AS i FROM grounded
), w AS (
  SELECT video_id, i, unnest(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '')) AS w FROM q
), t AS (
  SELECT video_id, i, ('0x' || left(md5(w), 8))::BIGINT % 384 AS b, sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::BIGINT % 2))::DOUBLE AS v FROM w GROUP BY ALL
), norms AS (
  SELECT video_id, i, nullif(sqrt(sum(v * v)), 0) AS n FROM t GROUP BY ALL
), alike AS (
  SELECT a.video_id, a.i, c.i AS j, sum(a.v * c.v) / (max(x.n) * max(y.n)) AS s
  FROM t a JOIN t c ON c.video_id = a.video_id AND c.b = a.b AND c.i < a.i
       JOIN norms x ON x.video_id = a.video_id AND x.i = a.i JOIN norms y ON y.video_id = c.video_id AND y.i = c.i
  GROUP BY ALL HAVING s >= 0.8 - 1e-6
), before AS (
  SELECT video_id, i, list(j) AS js FROM alike GROUP BY ALL
), walk AS (
  SELECT video_id, i, [i] AS kept FROM q WHERE i = 1
  UNION ALL
  SELECT q.video_id, q.i, CASE WHEN list_has_any(k.kept, coalesce(b.js, [])) THEN k.kept ELSE list_append(k.kept, q.i) END
  FROM walk k JOIN q ON q.video_id = k.video_id AND q.i = k.i + 1 LEFT JOIN before b ON b.video_id = q.video_id AND b.i = q.i
), last AS (
  SELECT video_id, arg_max(kept, i) AS kept FROM walk GROUP BY video_id
)"""


@register(
    "dedupe_questions",
    f"""{_REC}, {_CAP}, {_ANSWERED}, {_GREEDY}
SELECT q.video_id, segment_index, start, "end", question FROM q JOIN last USING (video_id) WHERE list_contains(kept, i)""",
)
def dedupe_questions(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    return questions.dedupe_questions(_accepted(spark, sf_dir, cap))


@register(
    "serialize_questions",
    f"""{_SEG}, {_CAP}, {_ANSWERED}
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start, segment_index)::INT AS id, question, start, "end", {_stamp("start")} AS timestamp,
       'https://www.youtube.com/watch?v=' || video_id || '&t=' || floor(start)::BIGINT || 's' AS youtube_url
FROM grounded""",
)
def serialize_questions(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    return questions.serialize_questions(_accepted(spark, sf_dir, cap))


@register(
    "cached_questions",
    f"""{_SEG}, {_CAP}, {_ANSWERED}, q AS (SELECT video_id, string_agg(question, chr(10) ORDER BY start, segment_index) AS questions FROM grounded GROUP BY video_id)
SELECT 'vid' || lpad(doc_id::VARCHAR, 8, '0') AS video_id, questions FROM documents LEFT JOIN q ON q.video_id = 'vid' || lpad(doc_id::VARCHAR, 8, '0')""",
)
def cached_questions(spark: SparkSession, sf_dir: str, cap: int = SMALL_CAP) -> DataFrame:
    out = index.cached_questions(D.videos(spark, sf_dir), _accepted(spark, sf_dir, cap))
    return out.select("video_id", F.array_join(F.transform("questions", lambda x: x["question"]), "\n").alias("questions"))


# The same chain with the operators' own limits, which the names end with; small limits are reached by more videos.
_OWN_CAP = _CAP.replace(f"<= {SMALL_CAP}\n", f"<= {P.CANDIDATES}\n")
_OWN = {f.__name__: (f, {}) for f in (cap_candidates, question_prompts, accept_questions, dedupe_questions, serialize_questions, cached_questions)}
for _name, (_f, _limits) in (_OWN | {"rank_questions": (rank_questions, {"rank": P.QUESTIONS})}).items():
    register(
        f"{_name}_{_limits.get('rank', P.CANDIDATES)}", REGISTERED[_name][1].replace(_CAP, _OWN_CAP).replace(f"<= {SMALL_RANK}", f"<= {P.QUESTIONS}")
    )(lambda spark, sf_dir, f=_f, limits=_limits: f(spark, sf_dir, P.CANDIDATES, **limits))


@register(
    "grounding_overlap",
    f"""{_SEG}, {_WINDOWS}, p AS (SELECT w.video_id, segment_index, {_of(_CONTENT, "left(text, length(text) // 2)")} AS a, {_of(_CONTENT, "substr(text, length(text) // 2 + 1)")} AS b FROM windows w)
SELECT video_id, segment_index, len(a) AS n_words, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END::DOUBLE AS overlap FROM p""",
)
def grounding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each window held against its second."""
    w, half = _windows(spark, sf_dir), F.floor(F.length("text") / 2).cast("int")
    a, b = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    return w.select("video_id", "segment_index", F.size(T.content_words(a)).cast("long").alias("n_words"), F.round(T.grounding_overlap(a, b), 6).alias("overlap"))


# --- index -----------------------------------------------------------------------------------------------------

_CHUNKED = f"{_SEG}, {D.VIDEOS}, has AS (SELECT DISTINCT video_id FROM segments)"


@register("indexed_videos", f"{_CHUNKED} SELECT video_id, title FROM videos WHERE status = 'ready' AND video_id IN (SELECT video_id FROM has)")
def indexed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.indexed_videos(D.videos(spark, sf_dir), _chunks(spark, sf_dir)).select("video_id", "title")


@register("cached_summaries", f"{_CHUNKED} SELECT video_id FROM videos WHERE status = 'ready' AND version = 3 AND video_id IN (SELECT video_id FROM has)")
def cached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.cached_summaries(D.videos(spark, sf_dir), _chunks(spark, sf_dir)).select("video_id")


@register("videos_to_process", f"{_CHUNKED} SELECT video_id FROM videos WHERE status <> 'ready' OR video_id NOT IN (SELECT video_id FROM has)")
def videos_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.videos(spark, sf_dir)
    return index.videos_to_process(v, index.indexed_videos(v, _chunks(spark, sf_dir))).select("video_id")


@register(
    "index_videos",
    f"""{_REC}, {_chunk_sql(P.CHUNK_WORDS)}, w AS (
  SELECT video_id, chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM chunks
), t AS (
  SELECT video_id, chunk_id, ('0x' || left(md5(w), 8))::BIGINT % {P.DIMENSION} AS place, sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::BIGINT % 2))::DOUBLE AS v FROM w GROUP BY ALL
)
SELECT video_id, chunk_id, place::INT AS place, round((v / sqrt(sum(v * v) OVER (PARTITION BY video_id, chunk_id)))::FLOAT::DOUBLE, 3) AS weight FROM t WHERE v <> 0""",
)
def index_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow: chunks with vectors of the hashing embedder; each vector's places that aren't zero."""
    e = flows.index_videos(D.segments(spark, sf_dir)).select("video_id", "chunk_id", F.posexplode("embedding").alias("place", "x"))
    return e.filter("x <> 0").select("video_id", "chunk_id", "place", F.round(F.col("x").cast("double"), 3).alias("weight"))


# --- retrieval -------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_PAIRS = f"""WITH {D.VECTORS}, pairs AS (
  SELECT question_id, q.video_id, chunk_id,
         {_DOT.format(a="q.embedding", b="v.embedding")} / (sqrt({_DOT.format(a="q.embedding", b="q.embedding")}) * sqrt({_DOT.format(a="v.embedding", b="v.embedding")})) AS similarity
  FROM asked q JOIN vectors v ON v.video_id = q.video_id
), top AS (
  SELECT question_id, video_id, chunk_id, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id)::INT AS rank
  FROM pairs QUALIFY rank <= 3
), retrieved AS (
  SELECT top.*, v.start, v."end", v.text FROM top JOIN vectors v USING (video_id, chunk_id)
)"""
_RETRIEVED = ["question_id", "video_id", "chunk_id", "similarity", "rank", "start", "end", "text"]


@register("question_chunk_pairs", f"{_PAIRS} SELECT question_id, video_id, chunk_id, round(similarity, 6) AS similarity FROM pairs")
def question_chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.question_chunk_pairs(D.asked(spark, sf_dir), D.vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@register("retrieve_chunks", f"{_PAIRS} SELECT * FROM retrieved")
def retrieve_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve_chunks(D.asked(spark, sf_dir), D.vectors(spark, sf_dir)).select(*_RETRIEVED)


@register("retrieve_chunks_blocked", f"{_PAIRS} SELECT * FROM retrieved")
def retrieve_chunks_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve_chunks_blocked(D.asked(spark, sf_dir), D.vectors(spark, sf_dir)).select(*_RETRIEVED)


@register("relevant_chunks", f"{_PAIRS} SELECT question_id, chunk_id, similarity FROM retrieved WHERE similarity >= 0.25")
def relevant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relevant_chunks(retrieve_chunks(spark, sf_dir)).select("question_id", "chunk_id", "similarity")


def _budget(spark: SparkSession, sf_dir: str, words: int = P.CONTEXT_WORDS) -> DataFrame:
    return retrieval.fit_word_budget(retrieval.relevant_chunks(retrieve_chunks(spark, sf_dir)), words)


#: The fold over at most three chunks, written out.
_BUDGET = rf"""w AS (
  SELECT *, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i
  FROM retrieved WHERE similarity >= 0.25
), one AS (
  SELECT question_id, max(CASE WHEN i = 1 THEN least(len(ws), {{m}}) END) AS a, max(CASE WHEN i = 2 THEN len(ws) END) AS b, max(CASE WHEN i = 3 THEN len(ws) END) AS c FROM w GROUP BY question_id
), kept AS (
  SELECT w.*, array_to_string(ws[1 : {{m}}], ' ') AS cut, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place
  FROM w JOIN one USING (question_id)
  WHERE i = 1 OR (i = 2 AND a + b <= {{m}}) OR (i = 3 AND a + CASE WHEN a + b <= {{m}} THEN b ELSE 0 END + c <= {{m}})
)"""


@register("fit_word_budget", f"{_PAIRS}, {_BUDGET.format(m=300)} SELECT question_id, chunk_id, similarity, cut AS text, place::INT AS place FROM kept")
def fit_word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 300 words, so that chunks are passed over and cut."""
    e = _budget(spark, sf_dir, 300).select("question_id", F.posexplode("chunks").alias("p", "c"))
    return e.select("question_id", "c.chunk_id", "c.similarity", "c.text", (F.col("p") + 1).alias("place"))


@register(
    "build_context",
    f"""{_PAIRS}, {_BUDGET.format(m=P.CONTEXT_WORDS)}
SELECT question_id, string_agg('[Chunk ' || place || ']' || chr(10) || 'Timestamp: ' || {_stamp("start")} || ' - ' || {_stamp('"end"')} || chr(10) || 'Text:' || chr(10) || cut, chr(10) || chr(10) ORDER BY place) AS context
FROM kept GROUP BY question_id""",
)
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir).select("question_id", C.build_context(F.col("chunks")).alias("context"))


@register(
    "build_sources",
    f"""{_PAIRS}, {_BUDGET.format(m=P.CONTEXT_WORDS)}, n AS (SELECT question_id, count(*) AS n FROM kept GROUP BY question_id)
SELECT question_id, chunk_id, start, "end", similarity, {_stamp("start")} || ' – ' || {_stamp('"end"')} AS label,
       'https://www.youtube.com/watch?v=' || video_id || '&t=' || floor(start)::BIGINT || 's' AS youtube_url
FROM kept JOIN n USING (question_id) WHERE question_id % 3 > n OR question_id % 3 = 0 OR place = question_id % 3""",
)
def build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited is the chunk of number question_id % 3; none (so all) for 0 or beyond the context."""
    n = F.col("question_id") % 3
    cited = F.when((n > 0) & (n <= F.size("chunks")), F.array(n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return _budget(spark, sf_dir).select("question_id", F.explode(C.build_sources(F.col("video_id"), F.col("chunks"), cited)).alias("s")).select("question_id", "s.*")


# --- chat ------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' messages as requests: some blank, some of videos that aren't known, some of other sessions' videos."""
    m = D.messages(spark, sf_dir).filter("role = 'user'")
    k, n = F.col("session_id").cast("long"), max(1, D.documents(spark, sf_dir).count())
    return m.select(
        "session_id", "msg_id",
        F.when(k % 7 == 6, F.lit("  ")).otherwise(F.concat(F.lit(" vid"), F.lpad(((k * 3) % n).cast("string"), 8, "0"))).alias("video_id"),
        F.when(F.col("msg_id") % 5 == 4, F.lit(" \n ")).otherwise(F.concat("message", F.lit("  "))).alias("message"),
    )


_REQUESTS = f"""{D.MESSAGES}, requests AS (
  SELECT session_id, msg_id, CASE WHEN session_id::BIGINT % 7 = 6 THEN '' ELSE 'vid' || lpad(((session_id::BIGINT * 3) % (SELECT count(*) FROM documents))::VARCHAR, 8, '0') END AS video_id,
         CASE WHEN msg_id % 5 = 4 THEN '' ELSE left(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), 1000) END AS message
  FROM messages WHERE role = 'user'
)"""


@register(
    "valid_requests",
    f"""{_CHUNKED}, {_REQUESTS}, ok AS (SELECT video_id FROM videos WHERE status = 'ready' AND video_id IN (SELECT video_id FROM has))
SELECT *, CASE WHEN video_id = '' OR message = '' THEN '{P.EMPTY_QUESTION}' WHEN video_id NOT IN (SELECT video_id FROM ok) THEN '{P.NOT_INDEXED.replace("'", "''")}' END AS error FROM requests""",
)
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = index.indexed_videos(D.videos(spark, sf_dir), _clean(spark, sf_dir))
    return chat.valid_requests(_requests(spark, sf_dir), known).select("session_id", "msg_id", "video_id", "message", "error")


@register(
    "resolve_sessions",
    f"""WITH {_REQUESTS}, own AS (SELECT DISTINCT session_id, 'vid' || lpad((session_id::BIGINT * 3 % (SELECT count(*) FROM documents))::VARCHAR, 8, '0') AS video_id FROM messages WHERE session_id::BIGINT % 2 = 0)
SELECT r.msg_id, r.video_id, CASE WHEN o.session_id IS NOT NULL THEN r.session_id ELSE 'new-' || r.session_id END AS session_id
FROM requests r LEFT JOIN own o ON o.session_id = r.session_id AND o.video_id = r.video_id""",
)
def resolve_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only even sessions are stored; the new ids are derived, so that runs agree."""
    k, n = F.col("session_id").cast("long"), max(1, D.documents(spark, sf_dir).count())
    s = D.messages(spark, sf_dir).select("session_id", F.concat(F.lit("vid"), F.lpad((k * 3 % n).cast("string"), 8, "0")).alias("video_id")).filter(k % 2 == 0).distinct()
    r = _requests(spark, sf_dir).withColumn("video_id", F.trim("video_id"))
    return chat.resolve_sessions(r, s, F.concat(F.lit("new-"), "session_id")).select("msg_id", "video_id", "session_id")


@register(
    "recent_history",
    f"""WITH {D.MESSAGES}, h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_s DESC, msg_id DESC) AS n FROM messages QUALIFY n <= 6)
SELECT session_id, msg_id, role, message, (max(n) OVER (PARTITION BY session_id) - n + 1)::INT AS place FROM h""",
)
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recent_history(D.messages(spark, sf_dir)).select("session_id", "msg_id", "role", "message", F.col("place").cast("int").alias("place"))


_FOLLOW = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){_sql_any(P.REFERRING)}{_B}|^\s*{_sql_any(P.FOLLOW_STARTS)}{_B}|^\s*(?:what|how) about{_B}"


@register("looks_like_follow_up", f"""WITH {D.MESSAGES} SELECT session_id, msg_id, {_of(_WORDS, "message")} <= 4 OR regexp_matches(message, '{_FOLLOW}') AS follows FROM messages""")
def looks_like_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.messages(spark, sf_dir).select("session_id", "msg_id", T.looks_like_follow_up(F.col("message")).alias("follows"))


@register(
    "rewrite_prompts",
    f"""WITH {D.MESSAGES}, h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_s DESC, msg_id DESC) AS n FROM messages QUALIFY n <= 6),
g AS (SELECT session_id, count(*)::INT AS history_size, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(message, 300), chr(10) ORDER BY n DESC) AS lines FROM h GROUP BY session_id)
SELECT session_id, msg_id, history_size, 'Conversation:' || chr(10) || lines || chr(10) || 'Latest question: ' || message || chr(10) || 'Standalone question:' AS user_message
FROM messages JOIN g USING (session_id) WHERE role = 'user'""",
)
def rewrite_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.messages(spark, sf_dir)
    out = chat.rewrite_prompts(m.filter("role = 'user'"), chat.recent_history(m))
    return out.select("session_id", "msg_id", "history_size", F.col("messages")[1]["content"].alias("user_message"))


@register(
    "answer_prompts",
    f"""{_PAIRS}, {_BUDGET.format(m=P.CONTEXT_WORDS)}, c AS (
  SELECT question_id, string_agg('[Chunk ' || place || ']' || chr(10) || 'Timestamp: ' || {_stamp("start")} || ' - ' || {_stamp('"end"')} || chr(10) || 'Text:' || chr(10) || cut, chr(10) || chr(10) ORDER BY place) AS context FROM kept GROUP BY question_id
)
SELECT question_id, 'USER QUESTION' || chr(10) || 'q' || question_id || CASE WHEN question_id % 20 = 0 THEN chr(10) || '(Interpreted as: r' || question_id || ')' ELSE '' END || chr(10) || chr(10) || 'VIDEO CONTEXT' || chr(10) || chr(10) || context AS user_message FROM c""",
)
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("q"), F.col("question_id").cast("string"))
    rows = _budget(spark, sf_dir).withColumn("message", q).withColumn("search_query", F.when(F.col("question_id") % 20 == 0, F.concat(F.lit("r"), F.col("question_id").cast("string"))).otherwise(q))
    return chat.answer_prompts(rows).select("question_id", F.col("messages")[1]["content"].alias("user_message"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, (" Sources: 1, 3.", " (Source: Chunk 2)", "", "\nSources: 9"))), ((F.col("session_id").cast("long") + F.col("msg_id")) % 4 + 1).cast("int"))
    return D.messages(spark, sf_dir).filter("role = 'assistant'").select("session_id", "msg_id", F.concat("message", mark).alias("answer"))


_MARKED = f"""WITH {D.MESSAGES}, marked AS (SELECT session_id, msg_id, (session_id::BIGINT + msg_id) % 4 AS k, regexp_replace(message, '^\\s+|\\s+$', '', 'g') AS answer FROM messages WHERE role = 'assistant')"""


@register("extract_citations", f"{_MARKED} SELECT session_id, msg_id, answer, CASE k WHEN 0 THEN '1,3' WHEN 1 THEN '2' ELSE '' END AS cited FROM marked")
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.extract_citations(F.col("answer"), F.lit(3))
    return _marked(spark, sf_dir).select("session_id", "msg_id", c.alias("c")).select("session_id", "msg_id", "c.answer", F.array_join("c.cited", ",").alias("cited"))


@register(
    "finalize_answer",
    f"""{_MARKED} SELECT session_id, msg_id, CASE WHEN k = 2 THEN '{P.NO_ANSWER.replace("'", "''")}' ELSE answer END AS answer, (CASE WHEN k = 2 THEN 0 ELSE 1 END)::INT AS n_sources, k = 2 OR answer <> '' AS success FROM marked""",
)
def finalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth answer also says that nothing was found."""
    k = (F.col("session_id").cast("long") + F.col("msg_id")) % 4
    a = T.strip(F.when(k == 2, F.concat("message", F.lit(" " + P.NO_ANSWER))).otherwise(F.col("message")))
    f = C.finalize_answer(a, F.array(F.struct(F.lit(1).alias("chunk_id"))))
    m = D.messages(spark, sf_dir).filter("role = 'assistant'")
    return m.select("session_id", "msg_id", f.alias("f")).select("session_id", "msg_id", "f.answer", F.size("f.sources").alias("n_sources"), "f.success")


@register(
    "accept_rewrite",
    f"""WITH {D.MESSAGES}, p AS (SELECT session_id, msg_id, message, regexp_replace(string_split(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^\\s+|\\s+$', '', 'g') AS line FROM messages)
SELECT session_id, msg_id, CASE WHEN msg_id > 0 AND msg_id % 3 <> 1 AND line <> '' AND length(line) <= 300 THEN line ELSE message END AS query FROM p""",
)
def accept_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message itself, quoted, stands for its rewrite; the turn's number for the history."""
    out = C.accept_rewrite(F.col("message"), F.concat(F.lit('"'), F.trim("message"), F.lit('"')), F.col("msg_id"), F.col("msg_id") % 3 != 1)
    return D.messages(spark, sf_dir).select("session_id", "msg_id", out.alias("query"))


@register(
    "append_messages",
    f"""{_MARKED}, ok AS (SELECT * FROM marked WHERE k <> 2)
SELECT session_id, 0 AS place, 'user' AS role, 'q' || msg_id AS message, 0 AS n_sources FROM ok UNION ALL SELECT session_id, 1, 'assistant', answer, 1 FROM ok""",
)
def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("session_id").cast("long") + F.col("msg_id")) % 4
    r = D.messages(spark, sf_dir).filter("role = 'assistant'").select(
        "session_id", F.concat(F.lit("q"), F.col("msg_id").cast("string")).alias("message"), T.strip(F.col("message")).alias("answer"), F.array(F.struct(F.lit(1).alias("chunk_id"))).alias("sources"), (k != 2).alias("success")
    )
    return chat.append_messages(r).select("session_id", "place", "role", "message", F.size("sources").alias("n_sources"))


@register(
    "audit_sources",
    f"""{_PAIRS} SELECT question_id AS msg_id, chunk_id, CASE WHEN question_id % 20 = 0 THEN 'other times' ELSE 'unknown chunk' END AS problem
FROM (SELECT question_id, CASE WHEN question_id % 20 = 10 THEN chunk_id + 100000 ELSE chunk_id END AS chunk_id FROM retrieved WHERE rank = 1)""",
)
def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best chunk stored as a source, with shifted times or an unknown id."""
    odd = F.col("question_id") % 20 == 10
    s = F.struct(F.when(odd, F.col("chunk_id") + 100000).otherwise(F.col("chunk_id")).alias("chunk_id"), (F.col("start") + 1).alias("start"), F.col("end").alias("end"))
    a = retrieve_chunks(spark, sf_dir).filter("rank = 1").select(F.lit("s").alias("session_id"), F.col("question_id").alias("msg_id"), "video_id", F.array(s).alias("sources"))
    return chat.audit_sources(a, D.vectors(spark, sf_dir)).select("msg_id", "chunk_id", "problem")


# --- summaries -------------------------------------------------------------------------------------------------

_C50 = f"{_REC}, {_chunk_sql(SMALL_CHUNK)}"
_PLAN = """plan AS (
  SELECT video_id, count(*) AS n_chunks, sum(word_count)::BIGINT AS total_words FROM chunks GROUP BY video_id
)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summary_plan(_chunks(spark, sf_dir, SMALL_CHUNK))


@register(
    "summary_plan",
    f"""{_C50}, {_PLAN} SELECT *, CASE WHEN total_words <= 700 THEN 'direct' ELSE 'map_reduce' END AS mode, CASE WHEN n_chunks >= 8 THEN 120 WHEN n_chunks >= 4 THEN 160 ELSE 240 END AS max_tokens,
       CASE WHEN n_chunks >= 8 THEN '{P.LENGTH_RULES[0][2]}' WHEN n_chunks >= 4 THEN '{P.LENGTH_RULES[1][2]}' ELSE '{P.LENGTH_RULES[2][2]}' END AS length_rule FROM plan""",
)
def summary_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


_BATCHES = """batches AS (
  SELECT video_id, chunk_id, text, word_count, ((row_number() OVER (PARTITION BY video_id ORDER BY length(text) DESC, chunk_id) - 1) // 16)::INT AS batch_id FROM chunks
)"""


@register("length_batches", f"{_C50}, {_BATCHES} SELECT video_id, chunk_id, batch_id FROM batches")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.length_batches(_chunks(spark, sf_dir, SMALL_CHUNK)).select("video_id", "chunk_id", "batch_id")


@register("batch_stats", f"{_C50}, {_BATCHES} SELECT video_id, batch_id, count(*) AS chunks, sum(word_count)::BIGINT AS input_words FROM batches GROUP BY ALL")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.batch_stats(summaries.length_batches(_chunks(spark, sf_dir, SMALL_CHUNK)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _two_messages(prompts: DataFrame, *keys: str) -> DataFrame:
    content = lambda i, name: F.col("messages")[i]["content"].alias(name)
    return prompts.select(*keys, content(0, "system_message"), content(1, "user_message"))


@register(
    "chunk_prompts",
    f"""{_C50}, {_PLAN} SELECT video_id, chunk_id, 'Transcript excerpt:' || chr(10) || chr(10) || text AS user_message,
       replace({_quoted(summaries.CHUNK_SYSTEM)}, '{{rule}}', CASE WHEN n_chunks >= 8 THEN '{P.LENGTH_RULES[0][2]}' WHEN n_chunks >= 4 THEN '{P.LENGTH_RULES[1][2]}' ELSE '{P.LENGTH_RULES[2][2]}' END) AS system_message
FROM chunks JOIN plan USING (video_id) WHERE total_words > 700""",
)
def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the rule of length by the number of chunks."""
    return _two_messages(summaries.chunk_prompts(summaries.planned_chunks(_chunks(spark, sf_dir, SMALL_CHUNK))), "video_id", "chunk_id")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = summaries.planned_chunks(_chunks(spark, sf_dir, SMALL_CHUNK))
    text = F.when(F.col("mode") == "direct", F.col("text")).otherwise(F.when(F.col("chunk_id") % 5 == 4, F.lit("")).otherwise(F.reverse("text")))
    return summaries.combine_sections(c.withColumn("text", text))


_COMBINED = """sections AS (
  SELECT video_id, chunk_id, CASE WHEN total_words <= 700 THEN 'direct' ELSE 'map_reduce' END AS mode,
         CASE WHEN total_words <= 700 THEN text WHEN chunk_id % 5 = 4 THEN '' ELSE trim(reverse(text)) END AS text
  FROM chunks JOIN plan USING (video_id)
), combined AS (
  SELECT video_id, mode, string_agg(CASE WHEN mode = 'direct' THEN '' ELSE 'Section ' || chunk_id || ': ' END || text, chr(10) || chr(10) ORDER BY chunk_id) AS combined
  FROM sections WHERE text <> '' GROUP BY ALL
)"""


@register("combine_sections", f"{_C50}, {_PLAN}, {_COMBINED} SELECT * FROM combined")
def combine_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's text backwards stands for its summary; every fifth is empty."""
    return _sections(spark, sf_dir)


@register(
    "final_prompts",
    f"{_C50}, {_PLAN}, {_COMBINED} SELECT video_id, CASE WHEN mode = 'direct' THEN 'Transcript:' ELSE 'Section summaries:' END || chr(10) || chr(10) || combined || '{summaries.FINAL_END}' AS user_message, ".replace(
        "\n\nNow", "' || chr(10) || chr(10) || 'Now"
    )
    + f"replace({_quoted(summaries.FINAL_SYSTEM)}, '{{source}}', CASE WHEN mode = 'direct' THEN 'its transcript' ELSE 'summaries of its sections, in order' END) AS system_message FROM combined",
)
def final_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_messages(summaries.final_prompts(_sections(spark, sf_dir)), "video_id")


def _whole_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs made of all lines of every text: plain, fenced and cut JSON, and prose."""
    lines = F.filter(F.split(F.translate("text", '"\\', ""), "\n"), lambda x: F.trim(x) != "")
    body = F.concat(F.lit('{"summary_lines": ["'), F.array_join(lines, '",\n"'), F.lit('"], "main_topics": ["a", " b "], "key_points": [], "conclusions": ["c"]}'))
    k = F.col("doc_id") % 4
    out = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.expr("left(body, length(body) - 2)")).otherwise(F.col("text"))
    return D.documents(spark, sf_dir).withColumn("body", body).select("doc_id", out.alias("raw"))


_WHOLE_OUTPUTS = """WITH l AS (
  SELECT doc_id, doc_id % 4 AS k, text, list_filter(string_split(replace(replace(text, '"', ''), chr(92), ''), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents
), b AS (
  SELECT *, '{"summary_lines": ["' || array_to_string(lines, '",' || chr(10) || '"') || '"], "main_topics": ["a", " b "], "key_points": [], "conclusions": ["c"]}' AS body FROM l
), o AS (
  SELECT doc_id, k, lines, k < 3 AND len(lines) > 0 AS parsed, len(lines) AS n, array_to_string(list_transform(lines, lambda x: trim(x)), chr(10)) AS summary,
         CASE k WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN left(body, length(body) - 2) ELSE text END AS raw
  FROM b
)"""


_PARSED = "SELECT doc_id, CASE WHEN parsed THEN summary END AS summary, CASE WHEN parsed THEN {topics} END AS topics FROM o"
_FINAL = "SELECT doc_id, CASE WHEN parsed THEN summary ELSE raw END AS summary, raw IS NOT NULL AND NOT parsed AS raw FROM o"


def _parse(outputs: DataFrame) -> DataFrame:
    p = outputs.withColumn("p", J.parse_summary(F.col("raw")))
    return p.select("doc_id", F.col("p.summary").alias("summary"), F.array_join("p.main_topics", ",").alias("topics"))


def _finish(outputs: DataFrame) -> DataFrame:
    f = outputs.withColumn("f", J.final_summary(F.col("raw")))
    return f.select("doc_id", F.col("f.summary").alias("summary"), F.col("f.raw_output").isNotNull().alias("raw"))


@register("parse_summary_whole", f"{_WHOLE_OUTPUTS} {_PARSED.format(topics="'a,b'")}")
def parse_summary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(_whole_outputs(spark, sf_dir))


@register("final_summary_whole", f"{_WHOLE_OUTPUTS} {_FINAL}")
def final_summary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, those that nothing can be read of too."""
    return _finish(_whole_outputs(spark, sf_dir))


@register("salvage_lines_whole", f"""{_WHOLE_OUTPUTS} SELECT doc_id, CASE WHEN parsed THEN greatest(n - CASE k WHEN 2 THEN 1 ELSE 2 END, 0) ELSE 0 END::BIGINT AS n FROM o""")
def salvage_lines_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows between the first and the last of JSON, plain or fenced; cut JSON ends in a quote, so its last row counts too. Prose has none."""
    lines = J.salvage_lines(F.col("raw"))
    return _whole_outputs(spark, sf_dir).select("doc_id", F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n"))


def _damaged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as JSON that a model spoiled: quotes within quotes, an end that is missing, a comma before it, an invalid escape."""
    k = F.col("doc_id") % 4
    clean = F.filter(F.split(F.translate("text", '"\\', ""), "\n"), lambda x: F.trim(x) != "")
    odd = F.transform(clean, lambda x: F.concat(F.trim(x), F.when(k == 0, ' the "odd" one').when(k == 3, "\\_x").otherwise("")))
    rows = F.concat(F.lit('{"summary_lines": ["'), F.array_join(odd, '",\n"'), F.lit('"'))
    end = F.when(k == 1, "").when(k == 2, ",\n ").otherwise('], "main_topics": ["a"]}')
    return D.documents(spark, sf_dir).select("doc_id", F.concat(rows, end).alias("raw"))


_DAMAGED_OUTPUTS = """WITH l AS (
  SELECT doc_id, doc_id % 4 AS k, list_transform(list_filter(string_split(replace(replace(text, '"', ''), chr(92), ''), chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS rows FROM documents
), b AS (
  SELECT *, len(rows) AS n, CASE k WHEN 0 THEN ' the "odd" one' WHEN 3 THEN '_x' ELSE '' END AS more, CASE k WHEN 0 THEN ' the "odd" one' WHEN 3 THEN chr(92) || '_x' ELSE '' END AS spoiled,
         CASE k WHEN 1 THEN '' WHEN 2 THEN ',' || chr(10) || ' ' ELSE '], "main_topics": ["a"]}' END AS finish FROM l
), o AS (
  SELECT *, n > 0 AS parsed, array_to_string(list_transform(rows, lambda x: x || more), chr(10)) AS summary, CASE WHEN k IN (0, 3) THEN 'a' ELSE '' END AS topics,
         '{"summary_lines": ["' || array_to_string(list_transform(rows, lambda x: x || spoiled), '",' || chr(10) || '"') || '"' || finish AS raw FROM b
)"""


@register("parse_summary", f"{_DAMAGED_OUTPUTS} {_PARSED.format(topics='topics')}")
def parse_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parse(_damaged_outputs(spark, sf_dir))


@register("final_summary", f"{_DAMAGED_OUTPUTS} {_FINAL}")
def finish_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finish(_damaged_outputs(spark, sf_dir))


@register(
    "salvage_lines",
    f"""{_DAMAGED_OUTPUTS} SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s, chr(10)) END AS lines
FROM (SELECT *, list_transform(rows[2 : n - CASE WHEN k IN (0, 3) THEN 1 ELSE 0 END], lambda x: x || spoiled) AS s FROM o)""",
)
def salvage_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows but the first; the last one only where nothing but a comma follows."""
    return _damaged_outputs(spark, sf_dir).select("doc_id", F.array_join(J.salvage_lines(F.col("raw")), "\n").alias("lines"))


@register("summary_stats", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_lines, " + _of(_WORDS, "text") + "::BIGINT AS n_words FROM documents")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.documents(spark, sf_dir).select("doc_id", T.summary_line_count(F.col("text")).cast("long").alias("n_lines"), T.summary_words(F.col("text")).cast("long").alias("n_words"))


def _attempt(text, raw):
    none = F.array().cast("array<string>")
    return F.struct(text.alias("summary"), none.alias("main_topics"), none.alias("key_points"), none.alias("conclusions"), raw.alias("raw_output"))


@register(
    "select_attempt",
    """WITH t AS (SELECT doc_id, text, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS head FROM documents),
n AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS b, len(list_filter(string_split(head, chr(10)), lambda x: trim(x) <> '')) AS a FROM t)
SELECT 'v' || doc_id AS video_id, CASE WHEN doc_id % 6 <> 5 AND doc_id % 4 <> 3 AND a < 15 AND b > a THEN text ELSE head END AS summary FROM n""",
)
def select_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First six lines, then all of them; some attempts weren't parsed."""
    d, k = D.documents(spark, sf_dir), F.col("doc_id")
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 6), "\n")
    v = F.concat(F.lit("v"), k.cast("string")).alias("video_id")
    first = d.select(v, _attempt(head, F.when(k % 6 == 5, head)).alias("summary"))
    retry = d.select(v, _attempt(F.col("text"), F.when(k % 4 == 3, F.col("text"))).alias("summary"))
    return summaries.select_attempt(first, retry).select("video_id", F.col("summary.summary").alias("summary"))


# --- scalar functions, outcomes --------------------------------------------------------------------------------


@register(
    "validate_url",
    f"""WITH {D.VIDEOS} SELECT doc_id, doc_id % 5 <> 3 AS valid, CASE WHEN doc_id % 5 <> 3 THEN video_id END AS video_id, CASE WHEN doc_id % 5 = 3 THEN '{P.BAD_URL}' END AS error FROM videos
UNION ALL SELECT page_id + 1000000, false, NULL, '{P.BAD_URL}' FROM pages""",
)
def validate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 1000000).alias("doc_id"), "url")
    u = D.videos(spark, sf_dir).select("doc_id", "url").unionByName(pages)
    return u.select("doc_id", T.validate_url(F.col("url")).alias("r")).select("doc_id", "r.valid", "r.video_id", "r.error")


@register(
    "normalize_metadata",
    """SELECT doc_id::VARCHAR AS video_id, CASE WHEN doc_id % 3 = 0 OR text = '' THEN 'Unknown title' ELSE text END AS title,
       CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 5 = 0 THEN 'Unknown channel' ELSE lang END AS channel, '' AS thumbnail FROM documents""",
)
def normalize_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = D.documents(spark, sf_dir), F.col("doc_id")
    return segments.normalize_metadata(
        d.select(
            k.cast("string").alias("video_id"), F.when(k % 3 != 0, F.col("text")).alias("title"), F.when(k % 2 == 0, F.col("source")).otherwise("").alias("channel"),
            F.when(k % 5 != 0, F.col("lang")).alias("uploader"), F.lit(None).cast("string").alias("thumbnail"),
        )
    )


@register(
    "format_times",
    f"""SELECT doc_id, {_stamp("n_chars * 1.25")} AS stamp, CASE WHEN n_chars % 10 = 0 THEN 'Unknown' ELSE regexp_replace({_stamp("n_chars * 1.25")}, '^0(.:..)$', '\\1') END AS duration,
       'https://www.youtube.com/watch?v=x&t=' || floor(n_chars * 1.25)::BIGINT || 's' AS url FROM documents""",
)
def format_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("n_chars") * 1.25
    d = F.when(F.col("n_chars") % 10 != 0, s)
    return D.documents(spark, sf_dir).select("doc_id", T.format_timestamp(s).alias("stamp"), T.format_duration(d).alias("duration"), T.timestamp_url(F.lit("x"), s).alias("url"))


_LABELLED = r"(?i)^\s*(?:answer|question|response)\s*:\s*"


@register(
    "normalize_question",
    rf"""{_SEG}, s AS (
  SELECT video_id, seg_idx, CASE seg_idx % 3 WHEN 0 THEN ' Answer: "' || text || '" ' WHEN 1 THEN ' ''' || text || ''' ' ELSE text END AS said FROM segments
), l AS (SELECT *, trim(regexp_replace(trim(said), '{_LABELLED}', '')) AS a FROM s),
t AS (SELECT *, trim(regexp_replace(regexp_replace(a, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')) AS t FROM l),
q AS (SELECT *, CASE WHEN t = '' THEN '' WHEN t LIKE '%?' THEN t ELSE regexp_replace(t, '[.!]+$', '') || '?' END AS q FROM t)
SELECT video_id, seg_idx, upper(left(q, 1)) || substr(q, 2) AS question, {_SCORE.replace("question", "q")}::INT AS score FROM q""",
)
def normalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as an answer of a model: labelled and quoted, in single quotes, or as it is."""
    k = F.col("seg_idx") % 3
    said = F.when(k == 0, F.concat(F.lit(' Answer: "'), "text", F.lit('" '))).when(k == 1, F.concat(F.lit(" '"), "text", F.lit("' "))).otherwise(F.col("text"))
    q = T.normalize_question(said)
    return _clean(spark, sf_dir).select("video_id", "seg_idx", q.alias("question"), T.relevance_score(q).cast("int").alias("score"))


@register(
    "content_words",
    f"""{_SEG} SELECT video_id, seg_idx, array_to_string(list_sort({_of(_CONTENT, "text")}), ' ') AS content FROM segments""",
)
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("video_id", "seg_idx", F.array_join(F.array_sort(T.content_words(F.col("text"))), " ").alias("content"))


@register(
    "pipeline_outcomes",
    f"""WITH s AS (SELECT 'v' || doc_id AS video_id, doc_id % 5 = 3 AS f1, doc_id % 7 = 4 AS f2, doc_id % 11 = 6 AS f3, doc_id % 3 = 2 AS f4 FROM documents)
SELECT video_id, NOT (f1 OR f2 OR f3) AS success, CASE WHEN f1 THEN 'url_validation' WHEN f2 THEN 'transcript_processing' WHEN f3 THEN 'summarization' END AS failed_stage,
       CASE WHEN f1 THEN '{P.BAD_URL}' WHEN f2 THEN '{P.NO_SEGMENTS}' WHEN f3 THEN '{P.NO_SUMMARY.replace("'", "''")}' END AS error, NOT (f1 OR f2 OR f3 OR f4) AS chat_available FROM s""",
)
def pipeline_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    one = lambda stage, bad, error: F.struct(F.lit(stage).alias("stage"), (~bad).alias("success"), F.when(bad, error).alias("error"))
    stages = F.array(
        one("summarization", k % 11 == 6, P.NO_SUMMARY), one("url_validation", k % 5 == 3, P.BAD_URL),
        one("indexing", k % 3 == 2, "index"), one("transcript_processing", k % 7 == 4, P.NO_SEGMENTS),
    )
    rows = D.documents(spark, sf_dir).select(F.concat(F.lit("v"), k.cast("string")).alias("video_id"), F.explode(stages).alias("s")).select("video_id", "s.*")
    return quality.pipeline_outcomes(rows)


@register("transcript_agreement")
def transcript_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript against itself without its every 25th word, in slices of 10 minutes."""
    s = _clean(spark, sf_dir)
    words = F.split("text", " ")
    before = F.sum(F.size(words)).over(Window.partitionBy("video_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_before", F.coalesce(before, F.lit(0)))
    less = F.array_join(F.filter(words, lambda w, i: (F.col("_before") + i) % 25 != 24), " ")
    windows = segments.fixed_windows(s.groupBy("video_id").agg(F.max("end").alias("duration")), AGREEMENT_SLICE).groupBy("video_id").agg(F.max("n").alias("last"))
    # a segment lies in the window of its start, an empty one at the very end in the last
    n = F.least(F.floor(F.col("start") / AGREEMENT_SLICE).cast("int"), F.coalesce("last", F.lit(0)))
    s = s.withColumn("thin", less).join(windows, "video_id", "left").withColumn("n", n)

    def whole(column: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("seg_idx", column)))
        return s.filter(F.col(column) != "").groupBy("video_id", "n").agg(F.array_join(F.transform(parts, lambda x: x[column]), " ").alias("text"))

    return quality.sliced_agreement(whole("thin").withColumn("run", F.lit("thinned")), whole("text"))


@register("usable_chunks_whole", """SELECT doc_id FROM documents WHERE regexp_replace(text, '\\s', '', 'g') <> ''""")
def usable_chunks_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.usable_chunks(D.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id")


@register("usable_chunks", """SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND regexp_replace(text, '\\s', '', 'g') <> ''""")
def usable_among_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text with all but its white space taken out."""
    blank = F.regexp_replace("text", r"(?U)\S", "")
    return summaries.usable_chunks(D.documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, blank).otherwise(F.col("text")).alias("text"))).select("doc_id")
