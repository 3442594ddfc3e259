"""Queries of spans, tokens and rendering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import spans as sp
from ..operators.passages import locate_passages
from ..sources.ragjson import context_column
from .registry import RESPONSES, SPANS, Catalogue, responses, spans, table

catalogue = Catalogue()
query = catalogue.add

#: Pieces with offsets, by a window sum.
PIECES = """raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n\\t]+|[ \\n\\t]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^ \\n\\t]+|[ \\n\\t]+'), 1) AS i FROM documents),
pieces AS (SELECT doc_id, CAST(i - 1 AS INT) AS token_index, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) AS INT) AS char_start,
  CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INT) AS char_end FROM raw)"""
#: Passages located in documents: the spans of responses.
LOCATED = """located AS (SELECT d.doc_id, b.item_id, CAST(instr(d.text, b.text) - 1 AS INT) AS s, CAST(instr(d.text, b.text) - 1 + length(b.text) AS INT) AS e
  FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0)"""


def located(spark, d):
    """(doc_id, item_id, start, end, again): benchmark passages in documents."""
    return locate_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"))


def labelled_pieces(spark, d):
    return sp.labelled_pieces(table(spark, d, "documents"), located(spark, d), "doc_id", "text")


@query("""SELECT d.doc_id, b.item_id, CASE WHEN instr(substr(d.text, instr(d.text, b.text) + 1), b.text) > 0 THEN 'ambiguous' ELSE 'ok' END AS status,
  CASE WHEN instr(substr(d.text, instr(d.text, b.text) + 1), b.text) = 0 THEN CAST(instr(d.text, b.text) - 1 AS INT) END AS s,
  CASE WHEN instr(substr(d.text, instr(d.text, b.text) + 1), b.text) = 0 THEN CAST(instr(d.text, b.text) - 1 + length(b.text) AS INT) END AS e
  FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0""")
def locate_unique(spark, d):
    once = F.col("again") < 0
    return located(spark, d).select("doc_id", "item_id", F.when(once, "ok").otherwise("ambiguous").alias("status"), F.when(once, F.col("start")).alias("s"), F.when(once, F.col("end")).alias("e"))


@query(f"""WITH {RESPONSES}, claimed AS (SELECT doc_id, response, k, CAST(doc_id % 40 + k * 3 AS INT) AS s, CAST(doc_id % 40 + k * 3 + 5 AS INT) AS e FROM responses, (VALUES (0), (1), (2)) v(k)),
  texts AS (SELECT doc_id, s, e, length(response) AS n, substr(response, s + 1, e - s) AS actual, CASE WHEN k = 2 THEN 'x' ELSE substr(response, s + 1, e - s) END AS claimed FROM claimed)
  SELECT doc_id, count(*) FILTER (WHERE e > n OR s >= e OR s < 0 OR actual <> claimed) AS n_bad FROM texts GROUP BY doc_id""")
def validate_spans(spark, d):
    rows = responses(spark, d)
    start = lambda k: (F.col("doc_id") % 40 + k * 3).cast("int")
    claim = lambda k: F.struct(start(k).alias("start"), (start(k) + 5).alias("end"), (F.lit("x") if k == 2 else F.substring(F.col("response"), start(k) + 1, F.lit(5))).alias("text"))
    return rows.withColumn("spans", F.array(*[claim(k) for k in range(3)])).select("doc_id", F.size(sp.bad_spans("response", "spans")).cast("bigint").alias("n_bad"))


_MERGED = f"""{SPANS}, opened AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY response_id ORDER BY s, e, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR
  row_number() OVER (PARTITION BY response_id ORDER BY s, e, ordinal) = 1 THEN 1 ELSE 0 END AS opens FROM spans),
  islands AS (SELECT *, sum(opens) OVER (PARTITION BY response_id ORDER BY s, e, ordinal ROWS UNBOUNDED PRECEDING) AS island FROM opened),
  types AS (SELECT response_id, island, label_type, row_number() OVER (PARTITION BY response_id, island ORDER BY min(s), min(e), min(ordinal)) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY response_id, island, label_type ORDER BY s, e, ordinal) AS r FROM islands WHERE label_type <> '') WHERE r = 1 GROUP BY response_id, island, label_type),
  merged AS (SELECT i.response_id, i.island, min(s) AS s, max(e) AS e, bool_or(implicit_true) AS implicit_true, bool_or(due_to_null) AS due_to_null FROM islands i GROUP BY 1, 2),
  named AS (SELECT response_id, island, string_agg(label_type, ' | ' ORDER BY k) AS label_type FROM types GROUP BY 1, 2)"""


@query(f"WITH {_MERGED} SELECT response_id, s, e, coalesce(label_type, '') AS label_type, implicit_true, due_to_null FROM merged LEFT JOIN named USING (response_id, island)")
def merge_spans(spark, d):
    return sp.merge_spans(spans(spark, d), "response_id").select("response_id", F.col("start").alias("s"), F.col("end").alias("e"), "label_type", "implicit_true", "due_to_null")


@query(f"WITH {SPANS} SELECT response_id, string_agg(label_type, ' | ' ORDER BY o) AS label_types FROM (SELECT response_id, label_type, min(ordinal) AS o FROM spans WHERE label_type <> '' GROUP BY ALL) GROUP BY response_id")
def distinct_types(spark, d):
    """Distinct label types in the order of their first appearance."""
    first = spans(spark, d).where("label_type <> ''").groupBy("response_id", "label_type").agg(F.min("ordinal").alias("o"))
    return first.groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "label_type"))), lambda x: x["label_type"]), " | ").alias("label_types"))


@query(f"WITH {LOCATED} SELECT d.doc_id, CAST(count(l.item_id) > 0 AS INT) AS response_label FROM documents d LEFT JOIN located l USING (doc_id) GROUP BY d.doc_id")
def response_label(spark, d):
    found = located(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return table(spark, d, "documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce((F.size("spans") > 0).cast("int"), F.lit(0)).alias("response_label"))


@query(f"WITH {PIECES} SELECT doc_id, count(*) AS n_pieces, CAST(max(char_end) AS INT) AS n_chars, CAST(sum(char_start) AS BIGINT) AS starts, CAST(max(length(piece)) AS INT) AS longest FROM pieces GROUP BY doc_id")
def tokenize(spark, d):
    """All pieces of all documents, summed up by document."""
    pieces = texts.pieces(table(spark, d, "documents"), "doc_id", "text")
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.max("char_end").alias("n_chars"), F.sum("char_start").cast("bigint").alias("starts"), F.max(F.length("piece")).alias("longest"))


@query(f"""WITH {PIECES}, {LOCATED} SELECT p.doc_id, p.token_index, p.char_start, p.char_end, p.piece FROM pieces p
  WHERE EXISTS (SELECT 1 FROM located l WHERE l.doc_id = p.doc_id AND p.char_start < l.e AND p.char_end > l.s)""")
def token_labels(spark, d):
    """The tokens that a located passage touches."""
    return labelled_pieces(spark, d).where("token_label = 1").select("doc_id", "token_index", "char_start", "char_end", "piece")


@query(f"""WITH {PIECES}, {LOCATED}, first AS (SELECT doc_id, min(item_id) AS item_id FROM located GROUP BY doc_id)
  SELECT l.doc_id, l.item_id, count(*) AS n_context_tokens, CAST(min(token_index) AS INT) AS first_token, CAST(max(token_index) AS INT) AS last_token
  FROM located l JOIN pieces p ON p.doc_id = l.doc_id AND p.char_start < l.e AND p.char_end > l.s GROUP BY l.doc_id, l.item_id""")
def context_tokens(spark, d):
    """Each passage's tokens in its document: their number, first and last."""
    hit = (F.col("char_start") < F.col("end")) & (F.col("char_end") > F.col("start"))
    rows = _pieces_and_passages(spark, d).where(hit)
    return rows.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_context_tokens"), F.min("token_index").alias("first_token"), F.max("token_index").alias("last_token"))


def _pieces_and_passages(spark, d):
    """The pieces of documents that hold passages, beside each of those; an equi-join by document."""
    found = located(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.join(found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "end")).alias("_found")), "doc_id")
    return texts.pieces(rows, "doc_id", "text", ("_found",)).select("*", F.inline("_found")).drop("_found")


@query(f"WITH {PIECES}, {LOCATED} SELECT l.doc_id, l.item_id, count(p.token_index) AS n_prefix_tokens FROM located l LEFT JOIN pieces p ON p.doc_id = l.doc_id AND p.char_end <= l.s GROUP BY l.doc_id, l.item_id")
def whole_prefix(spark, d):
    """The attended positions before a passage's first token."""
    return _pieces_and_passages(spark, d).groupBy("doc_id", "item_id").agg(F.count_if(F.col("char_end") <= F.col("start")).alias("n_prefix_tokens"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS token_index FROM conversations")
def token_index(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("int").alias("token_index"))


@query(f"""WITH {PIECES} SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE token_index = 0) AS n_without, CAST(coalesce(sum(token_index - 1) FILTER (WHERE token_index > 0), 0) AS BIGINT) AS predictors FROM pieces
  WHERE regexp_matches(piece, '[^ \\n\\t]') GROUP BY doc_id""")
def predictor_position(spark, d):
    """The position before each visible token; skipped white space doesn't shift it. Position 0 has none."""
    pieces = texts.pieces(table(spark, d, "documents"), "doc_id", "text").where(F.col("piece").rlike("[^ \\n\\t]"))
    at = F.when(F.col("token_index") > 0, F.col("token_index") - 1)
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(at.isNull()).alias("n_without"), F.coalesce(F.sum(at), F.lit(0)).cast("bigint").alias("predictors"))


@query(f"""WITH {PIECES} SELECT p.doc_id, d.lang AS task, d.source, p.token_index, p.char_start, p.char_end, length(p.piece) AS feature_length
  FROM pieces p JOIN documents d ON d.doc_id = p.doc_id""")
def feature_rows(spark, d):
    """Feature rows: a document's metadata repeated over its tokens, and a feature of each."""
    docs = table(spark, d, "documents")
    pieces = texts.pieces(docs.withColumnRenamed("lang", "task"), "doc_id", "text", ("task", "source")).withColumn("feature_length", F.length("piece").cast("bigint"))
    return pieces.select("doc_id", "task", "source", "token_index", "char_start", "char_end", "feature_length")


@query(r"""SELECT conv_id, '<|system|>' || chr(10) || coalesce(max(text) FILTER (WHERE role = 'system'), '') || '<|end|>' || chr(10) || '<|user|>' || chr(10) ||
  coalesce(min_by(text, turn) FILTER (WHERE role = 'user'), '') || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || coalesce(min_by(text, turn) FILTER (WHERE role = 'assistant'), '') AS rendered
  FROM conversations GROUP BY conv_id""")
def render_chat(spark, d):
    turn = lambda role: F.coalesce(F.min_by("text", F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("role") == "system", F.col("text"))), F.lit("")).alias("s"), turn("user").alias("u"), turn("assistant").alias("a"))
    return rows.select("conv_id", texts.render_chat("s", "u", "a").alias("rendered"))


@query(r"SELECT page_id, regexp_matches(html, '^\s|\s$') AS outer_whitespace FROM pages")
def outer_whitespace(spark, d):
    return table(spark, d, "pages").select("page_id", texts.outer_whitespace("html").alias("outer_whitespace"))


@query("SELECT page_id, sha256(replace(html, chr(13) || chr(10), chr(10))) AS digest FROM pages")
def canonical_newline_hash(spark, d):
    return table(spark, d, "pages").select("page_id", texts.canonical_newline_hash("html").alias("digest"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN text ELSE json_extract_string(CAST({'passages': text, 'question': lang} AS JSON), '$.passages') END AS context FROM documents")
def extract_context(spark, d):
    """Contexts by task from raw JSON, as the loader gets them: a plain string, or the passages of a record."""
    docs = table(spark, d, "documents")
    raw = F.when(F.col("lang").isin("en", "de"), F.to_json(F.struct(F.col("text").alias("v")))).otherwise(F.to_json(F.struct(F.struct(F.col("text").alias("passages"), F.col("lang").alias("question")).alias("v"))))
    kind = F.when(F.col("lang").isin("en", "de"), "Summary").otherwise("QA")
    return docs.select("doc_id", context_column(kind, raw, "v").alias("context"))


@query("SELECT n_nationkey, '| ' || n_nationkey || ' | ' || replace(replace(n_name, '|', '\\|'), chr(10), ' ') || ' | ' || n_regionkey || ' |' AS line FROM nation")
def markdown_rows(spark, d):
    return table(spark, d, "nation").select("n_nationkey", texts.markdown_row("n_nationkey", "n_name", "n_regionkey").alias("line"))


@query(f"""WITH {PIECES}, {LOCATED} SELECT d.doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM located l WHERE l.doc_id = p.doc_id AND p.char_start < l.e AND p.char_end > l.s)) AS n_positive
  FROM documents d JOIN pieces p ON p.doc_id = d.doc_id WHERE regexp_matches(piece, '[^ \\n\\t]') GROUP BY d.doc_id""")
def align(spark, d):
    """Each response's visible tokens, and how many of them touch an annotated span."""
    rows = labelled_pieces(spark, d).where(F.col("piece").rlike("[^ \\n\\t]"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("token_label").cast("bigint").alias("n_positive"))
