"""Shared CTEs, written from the fixture rules and operator definitions, not from the Spark code."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def oracle(key: str, body: str) -> None:
    ORACLES[key] = body.strip()


def _needed(sql: str, seen: list[str]) -> None:
    for name in CTES:
        # a CTE is always named right after FROM or JOIN
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(CTES[name].replace(f"FROM {name} ", "").replace(f"JOIN {name} ", ""), seen)
            if name not in seen:
                seen.append(name)


def expand(body: str) -> str:
    """Prefix a body with the CTEs it uses, in dependency order."""
    seen: list[str] = []
    _needed(body, seen)
    if not seen:
        return body
    defs = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in seen)
    # RECURSIVE is harmless for the others
    return f"WITH RECURSIVE {defs}\n{body}"


def prf(tp: str, fp: str, fn: str) -> str:
    """precision, recall, f1 with empty/empty = 1 and other zero denominators = 0."""
    def one(num: str, den: str) -> str:
        return (f"CASE WHEN ({tp})+({fp})+({fn})=0 THEN 1.0 WHEN ({den})=0 THEN 0.0 "
                f"ELSE CAST({num} AS DOUBLE)/({den}) END")
    return (f"{one(tp, f'({tp})+({fp})')} AS precision, {one(tp, f'({tp})+({fn})')} AS recall, "
            f"{one(f'2*({tp})', f'2*({tp})+({fp})+({fn})')} AS f1")


cte("base", """SELECT doc_id AS d, 2 + doc_id % 3 AS nb, 24*(2 + doc_id % 3) + 8 AS len,
  CAST(doc_id AS VARCHAR) AS rna_id FROM documents""")
cte("src", "SELECT * FROM (VALUES (0,'src_a'),(1,'src_b'),(2,'src_c')) v(s, source)")
cte("blk", "SELECT base.*, b, 2 + (d+b) % 4 AS g FROM base, range(0,4) r(b) WHERE b < nb")
cte("truth", """SELECT rna_id, 24*b+2+k AS i, 24*b+21-k AS j FROM blk, range(0,8) r(k) WHERE k < g
  UNION ALL SELECT rna_id, 24*b+9, 24*b+14 FROM blk WHERE (d+2*b) % 5 = 0
  UNION ALL SELECT rna_id, 11, 36 FROM base WHERE d % 17 = 0""")
cte("sblk", "SELECT blk.*, s, source, (7*d + 5*b + 3*s) % 11 AS v FROM blk CROSS JOIN src")
cte("pred", """SELECT rna_id, source, 24*b+2+k AS i, (CASE WHEN v = 6 THEN 24*b+22 ELSE 24*b+21 END)-k AS j
    FROM sblk, range(0,8) r(k)
    WHERE (v IN (0,1,2,3,6,8) AND k < g) OR (v = 4 AND k >= 1 AND k < g) OR (v = 5 AND k <= g)
       OR (v = 9 AND k < g AND k <> 2) OR (v = 10 AND k >= 1 AND k <= g)
  UNION ALL SELECT rna_id, source, 24*b+9, 24*b+15 FROM sblk WHERE v = 8
  UNION ALL SELECT rna_id, source, 24*b+10, 24*b+14 FROM sblk WHERE v = 8
  UNION ALL SELECT rna_id, source, 24*b+9, 24*b+14 FROM sblk WHERE v IN (0,1,2) AND (d+2*b) % 5 = 0
  UNION ALL SELECT rna_id, 'src_a', 11, 36 FROM base WHERE d % 34 = 0""")
cte("rec", "SELECT rna_id, d, len, s, source FROM base CROSS JOIN src")
cte("seqs", """SELECT rna_id, string_agg(substr('ACGU', CAST((3*d+7*p+p//5) % 4 AS INTEGER)+1, 1), '' ORDER BY p) AS sequence
  FROM base, range(0,104) r(p) WHERE p < len GROUP BY rna_id""")
cte("ev", """SELECT p.rna_id, p.source, CAST(p.rna_id AS BIGINT) % 5 AS fold,
    CASE CAST(p.rna_id AS BIGINT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS "partition",
    p.i, p.j, CASE WHEN t.i IS NULL THEN 1 ELSE 0 END AS label_delete,
    ((131*CAST(p.rna_id AS BIGINT) + 31*p.i + 17*p.j + 7*src.s) % 700
      + 300*(CASE WHEN t.i IS NULL THEN 1 ELSE 0 END)) / 1000.0::DOUBLE AS risk,
    n.gt_pair_count
  FROM pred p JOIN src USING (source) LEFT JOIN truth t ON t.rna_id=p.rna_id AND t.i=p.i AND t.j=p.j
  JOIN (SELECT rna_id, count(*) AS gt_pair_count FROM truth GROUP BY 1) n ON n.rna_id=p.rna_id""")
cte("tsrc", "SELECT t.rna_id, source, i, j FROM truth t CROSS JOIN src")
cte("status", """SELECT coalesce(t.rna_id,p.rna_id) AS rna_id, coalesce(t.source,p.source) AS source,
    coalesce(t.i,p.i) AS i, coalesce(t.j,p.j) AS j,
    CASE WHEN t.i IS NULL THEN 'FP' WHEN p.i IS NULL THEN 'FN' ELSE 'TP' END AS status
  FROM tsrc t FULL JOIN pred p ON t.rna_id=p.rna_id AND t.source=p.source AND t.i=p.i AND t.j=p.j""")
cte("counts", """SELECT rec.rna_id, rec.source, count(*) FILTER (status='TP') AS tp, count(*) FILTER (status='FP') AS fp,
    count(*) FILTER (status='FN') AS fn FROM rec LEFT JOIN status st ON st.rna_id=rec.rna_id AND st.source=rec.source GROUP BY 1,2""")
cte("metrics", f"SELECT *, {prf('tp','fp','fn')} FROM counts")
