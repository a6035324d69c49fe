"""RET-1..4 and EVR-3: sections, blocks, chunks, tokens, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.operators import corpus as c
from wardlight.operators.lexical import token_rows
from wardlight.operators.relevance import containment_gold

# lines that open a section in the driver's documents, which have no headings
OPENERS = "(?:The|Le|La|De|In|El) "


@check("ret_01_split_sections", r"""
WITH ln AS (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS line FROM
  (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
hd AS (SELECT *, regexp_matches(line, '^(?:The|Le|La|De|In|El) ') AS h FROM ln),
sc AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM hd),
ag AS (SELECT doc_id, s, bool_or(h) AS h, arg_min(line, p) AS first, string_agg(line, chr(10) ORDER BY p) AS body FROM sc GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS section_no,
 CASE WHEN h THEN regexp_replace(first, '^\s+|\s+$', '', 'g') ELSE 'Introducao' END AS section,
 regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM ag""")
def _(t):
    return c.split_sections(t.documents.select("doc_id", "text"), OPENERS)


_BLOCKS = """w AS (SELECT doc_id, text, 0 AS i, 0 AS p FROM documents),
r AS (SELECT doc_id, text, i, p, CASE WHEN length(text) <= 1100 THEN length(text)
   WHEN strpos(reverse(substr(text, 451, 450)), chr(10)) > 0
     THEN 900 - strpos(reverse(substr(text, 451, 450)), chr(10)) ELSE 900 END AS e FROM w
  UNION ALL
  SELECT doc_id, text, ni, p + 1,
   CASE WHEN ni + 900 < length(text) AND strpos(reverse(substr(text, ni + 451, 450)), chr(10)) > 0
     THEN ni + 900 - strpos(reverse(substr(text, ni + 451, 450)), chr(10)) ELSE least(ni + 900, length(text)) END
  FROM (SELECT *, greatest(e - 120, i + 1) AS ni FROM r WHERE e < length(text))),
bl AS (SELECT doc_id, p AS block_no, CASE WHEN length(text) <= 1100 THEN text
  ELSE regexp_replace(substr(text, i + 1, e - i), '^\\s+|\\s+$', '', 'g') END AS block FROM r)"""


@check("ret_02_split_long", f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, block_no, block FROM bl")
def _(t):
    return c.split_long(t.documents.select("doc_id", F.col("text").alias("body")))


_CHUNKS = f"""{_BLOCKS.replace("documents", "(SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE text <> '')")},
nm AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS INTEGER) AS chunk_no, block
 FROM bl WHERE length(regexp_replace(block, '^\\s+|\\s+$', '', 'g')) >= 40),
ch AS (SELECT CAST(doc_id AS VARCHAR) || '::' || CASE WHEN chunk_no < 1000 THEN lpad(CAST(chunk_no AS VARCHAR), 3, '0') ELSE CAST(chunk_no AS VARCHAR) END AS chunk_id,
 doc_id, source, chunk_no, 'Introducao' AS section, block AS text FROM nm JOIN (SELECT doc_id, source FROM documents) d USING (doc_id))"""


@check("ret_03_chunks", f"WITH RECURSIVE {_CHUNKS} SELECT * FROM ch")
def _(t):
    return c.chunks(t.documents)


@check("ret_04_tokens", """
SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
GROUP BY 1, 2""")
def _(t):
    return token_rows(t.documents, "doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@check("evr_03_containment_gold", """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def _(t):
    return containment_gold(t.benchmark, t.documents)
