"""Oracle SQL: reading, decoding, validation. Outcomes follow from the fault rules, not from parsing."""

from oracles.base import cte, oracle

cte("brk", """SELECT rec.rna_id, rec.source, CASE WHEN d%13=0 THEN 'length_mismatch' WHEN d%23=5 THEN 'illegal_structure_character'
   WHEN d%17=3 AND EXISTS (SELECT 1 FROM pred p WHERE p.rna_id=rec.rna_id AND p.source=rec.source AND p.i=2) THEN 'unmatched_bracket'
   WHEN d%19=4 THEN 'unmatched_bracket' END AS code FROM rec""")
oracle("v1_pairs_from_brackets", """SELECT rna_id, source, p.i, p.j, 'ok' AS code FROM pred p JOIN brk USING (rna_id, source) WHERE code IS NULL
   UNION ALL SELECT rna_id, source, NULL, NULL, code FROM brk WHERE code IS NOT NULL""")
cte("lst", """SELECT rna_id, CASE WHEN d%29=0 THEN 'invalid_index_base' WHEN d%41=3 THEN 'self_pair' WHEN d%31=1 THEN 'reversed_pair'
   WHEN d%37=2 THEN 'duplicate_pair' WHEN d%43=4 THEN 'out_of_range_pair' WHEN d%47=5 THEN 'multiple_partners' END AS code FROM base""")
_acc = """SELECT rna_id, t.i, t.j, 'ok' AS code FROM truth t JOIN {c} USING (rna_id) WHERE code IS NULL
   UNION ALL SELECT rna_id, NULL, NULL, code FROM {c} WHERE code IS NOT NULL"""
oracle("v2_pairs_from_list", _acc.format(c="lst"))
cte("mtx", """SELECT rna_id, CASE WHEN d%23=4 THEN 'invalid_matrix_shape' WHEN d%19=3 THEN 'invalid_matrix_value' WHEN d%11=1 THEN 'self_pair'
   WHEN d%13=2 THEN 'asymmetric_matrix' WHEN d%7=5 THEN 'multiple_partners' END AS code FROM base""")
oracle("v3_pairs_from_matrix", _acc.format(c="mtx"))
cte("mixd", """SELECT rna_id, CASE WHEN d%29=7 THEN 'unsupported_format' WHEN d%4=0 AND d%17=0 THEN 'illegal_structure_character' END AS code FROM base""")
oracle("v4_ingest_by_format", _acc.format(c="mixd"))
cte("pool", "SELECT p.rna_id, (s+1)*100000+i AS o, i, j FROM pred p JOIN src USING (source)")
cte("poolbad", """SELECT rna_id, arg_min(code, o*10+w) AS code FROM (
   SELECT rna_id, o, 0 AS w, 'duplicate_pair' AS code FROM (SELECT *, row_number() OVER (PARTITION BY rna_id,i,j ORDER BY o) AS n FROM pool) WHERE n>1
   UNION ALL SELECT rna_id, o, 1, 'multiple_partners' FROM (SELECT *, lag(p) OVER (PARTITION BY rna_id, e ORDER BY o) AS q FROM
     (SELECT rna_id, o, i AS e, j AS p FROM pool UNION ALL SELECT rna_id, o, j, i FROM pool)) WHERE q<>p) GROUP BY 1""")
oracle("v5_validate_pairs", """SELECT rna_id, i, j, 'ok' AS code FROM pool WHERE rna_id NOT IN (SELECT rna_id FROM poolbad)
   UNION ALL SELECT rna_id, NULL, NULL, code FROM poolbad""")
oracle("v6_partner_conflicts", """SELECT rna_id, position, string_agg(CAST(partner AS VARCHAR), ',' ORDER BY partner) AS partners FROM (
   SELECT DISTINCT rna_id, i AS position, j AS partner FROM pred UNION SELECT rna_id, j, i FROM pred) GROUP BY 1,2 HAVING count(*)>1""")
oracle("v7_validate_sequences", """SELECT rna_id, CASE WHEN d%17=0 THEN 'empty' WHEN d%7=0 OR d%11=0 THEN 'not_upper_or_whitespace' ELSE 'illegal_symbol' END AS code
   FROM base WHERE d%17=0 OR d%7=0 OR d%11=0 OR d%13=0""")
oracle("v8_validate_record_contract", """SELECT 'documents__'||rna_id||'__'||source AS record_id, CASE d%10 WHEN 1 THEN 'schema_version' WHEN 2 THEN 'sequence_length'
   WHEN 3 THEN 'provenance_empty' WHEN 4 THEN 'provenance_incomplete' WHEN 5 THEN 'prediction_not_canonical' WHEN 6 THEN 'sequence'
   WHEN 7 THEN 'missing_truth' END AS violations FROM rec LEFT JOIN (SELECT rna_id, source, count(*) AS n FROM pred GROUP BY 1,2) c USING (rna_id, source)
   WHERE d%10 IN (1,2,3,4,6,7) OR (d%10=5 AND n>1)""")
oracle("v9_validate_panel", """SELECT 'documents__'||rna_id||'__src_a' AS key, 'duplicate_record_id' AS finding FROM base WHERE d%50=4
   UNION ALL SELECT rna_id, 'panel_incomplete' FROM base WHERE d%50 IN (3,4)
   UNION ALL SELECT rna_id, 'sequence_disagrees' FROM seqs WHERE CAST(rna_id AS BIGINT)%50=5 AND sequence<>reverse(sequence)
   UNION ALL SELECT rna_id, 'truth_disagrees' FROM base WHERE d%50=6""")
cte("cells", """SELECT e.rna_id, e.source, len, i, j, s FROM (
     SELECT rna_id, source, i, j, (1-risk)*f AS s FROM evf UNION ALL SELECT rna_id, source, j, i, (1-risk)*f + low FROM evf
     UNION ALL SELECT rna_id, source, i, i, 0.5 FROM evf) e JOIN base USING (rna_id)""")
cte("evf", """SELECT *, CASE WHEN CAST(rna_id AS BIGINT)%15=1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f,
   CASE WHEN CAST(rna_id AS BIGINT)%10=0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS low FROM ev""")
cte("screp", """SELECT *, CASE WHEN min_score_before<0 OR max_score_before>1 THEN 'range' WHEN max_asymmetry_before>1e-7 THEN 'asymmetric' END AS code FROM (
   SELECT c.rna_id, c.source, count(*) FILTER (i=j AND s<>0) AS diagonal_nonzero_before, 0.0 AS diagonal_min_before, 0.5 AS diagonal_max_before,
     max(abs(s - coalesce(o,s))) AS max_asymmetry_before, least(min(s),0) AS min_score_before, greatest(max(s),0) AS max_score_before,
     0 AS diagonal_nonzero_after, max(abs(s - coalesce(o,s))) AS max_asymmetry_after, least(min(s) FILTER (i<>j),0) AS min_score_after,
     greatest(max(s) FILTER (i<>j),0) AS max_score_after, 0.0 AS max_off_diagonal_change
   FROM cells c LEFT JOIN (SELECT rna_id, source, j AS i, i AS j, s AS o FROM cells WHERE i<>j) m USING (rna_id, source, i, j) GROUP BY 1,2)""")
oracle("v10_normalize_scores", "SELECT * FROM screp")
oracle("v10_normalized_cells", """SELECT rna_id, source, count(*) AS cells, sum(CASE WHEN i=j THEN 0 ELSE s END) AS total, 0 AS diagonal_total
   FROM cells JOIN screp USING (rna_id, source) WHERE code IS NULL GROUP BY 1,2""")
oracle("v11_record_id", """SELECT *, CASE WHEN record_id IS NULL THEN 'empty_component' END AS code FROM (
   SELECT doc_id, CASE WHEN w<>'' AND l<>'' AND s<>'' THEN 'docs_v1__'||doc_id||'__'||l||'__'||s||'__'||w END AS record_id FROM (
   SELECT doc_id, trim(regexp_replace(lower(CASE WHEN doc_id%50=7 THEN '?!' ELSE text END),'[^a-z0-9]+','_','g'),'_') AS w,
     trim(regexp_replace(lower(lang),'[^a-z0-9]+','_','g'),'_') AS l, trim(regexp_replace(lower(source),'[^a-z0-9]+','_','g'),'_') AS s FROM documents))""")
oracle("v12_warnings_summary", """SELECT CASE WHEN source='src_b' THEN 'alias_applied' ELSE 'settings_unknown' END AS code, count(*) AS n FROM rec WHERE d%3=0 GROUP BY 1""")
oracle("v13_coverage_join_audit", """SELECT doc_id, 'missing' AS finding FROM documents WHERE doc_id NOT IN (SELECT o_custkey FROM orders)
   UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents)
   UNION ALL SELECT o_custkey, 'duplicate' FROM orders GROUP BY 1 HAVING count(*)>1""")
oracle("v14_validity_summary", """SELECT source, count(*) AS records, count(*) FILTER (b.code IS NULL) AS valid, count(b.code) AS invalid,
   count(s.max_score_before) AS with_scores, count(s.code) AS score_rejects, max(max_asymmetry_before) AS max_asymmetry,
   sum(diagonal_nonzero_before) AS diagonal_nonzero, min(min_score_before) AS min_score, max(max_score_before) AS max_score
   FROM rec JOIN brk b USING (rna_id, source) LEFT JOIN screp s USING (rna_id, source) GROUP BY 1""")
oracle("v15_score_drift", """SELECT rna_id, count(*) AS n, max(abs((1-a.risk)-(1-b.risk))) AS max_drift, count(*) FILTER (a.risk IS NULL OR b.risk IS NULL) AS unmatched,
   count(*) FILTER (1-a.risk = 1-b.risk)::DOUBLE/count(*) AS equal_fraction
   FROM (SELECT * FROM ev WHERE source='src_a') a FULL JOIN (SELECT * FROM ev WHERE source='src_b') b USING (rna_id, i, j) GROUP BY 1""")
oracle("s1_read_records", """SELECT 'record' AS kind, source, count(*) AS n, coalesce(sum(n),0) AS pairs, '0.5' AS parameters FROM rec
     LEFT JOIN (SELECT rna_id, source, count(*) AS n FROM pred GROUP BY 1,2) c USING (rna_id, source) GROUP BY 2
   UNION ALL SELECT 'reject', NULL, count(*), NULL, NULL FROM rec WHERE d%20=0""")
oracle("s2_ingest_structures", """SELECT 'structures/'||rna_id AS path, CASE WHEN code='ok' THEN rna_id END AS rna_id, CASE WHEN code='ok' THEN len END AS length,
   CASE WHEN code='ok' THEN CASE WHEN d%2=0 THEN 1 ELSE 0 END END AS has_sequence, code FROM (SELECT *,
     CASE WHEN d%26=8 THEN 'length_mismatch' WHEN d%31=2 THEN 'layout' ELSE 'ok' END AS code FROM base)""")
oracle("s3_ingest_scores", """SELECT 'scores/'||rna_id AS path, count(*) AS cells, sum((d+3*r+5*c)%1000) AS total,
     sum(((d+3*r+5*c)%1000)*(r+2*c)) AS weighted, 'ok' AS code FROM base, range(0,104) a(r), range(0,104) b(c)
     WHERE r<len AND c<len AND d%21<>4 AND d%25<>6 GROUP BY 1
   UNION ALL SELECT 'scores/'||rna_id, NULL, NULL, NULL, CASE WHEN d%21=4 THEN 'layout' ELSE 'matrix' END FROM base WHERE d%21=4 OR d%25=6""")
oracle("s4_ingest_dotplot", """SELECT 'plots/'||rna_id AS path, count(*) AS cells, sum(pow(((d+3*r+5*c)%100)/100.0::DOUBLE,2)) AS total, 'ok' AS code
     FROM base, range(1,105) a(r), range(1,105) b(c) WHERE r<c AND c<=len AND d%20 NOT IN (3,4,5) GROUP BY 1
   UNION ALL SELECT 'plots/'||rna_id, NULL, NULL, CASE d%20 WHEN 3 THEN 'incomplete' WHEN 4 THEN 'duplicate' ELSE 'invalid_record' END FROM base WHERE d%20 IN (3,4,5)""")
oracle("s5_write_tables", "SELECT kind, count(*) AS n, sum(risk) AS risk FROM ev, (VALUES ('parquet'),('csv'),('csv.gz'),('json')) v(kind) GROUP BY 1")
oracle("s6_read_partition", "SELECT rna_id, source, i, j, risk FROM ev WHERE fold=1 AND risk>=0.5")
oracle("s7_asset_manifest", """SELECT rna_id, role, CASE WHEN (d+r)%17=0 THEN 'missing' WHEN (d+r)%23=0 THEN 'ambiguous' ELSE 'empty' END AS code
     FROM base, (VALUES (0,'truth'),(1,'src_a'),(2,'src_b'),(3,'src_c')) v(r, role) WHERE (d+r)%17=0 OR (d+r)%23=0 OR (d+r)%19=0
   UNION ALL SELECT rna_id, source, code FROM brk WHERE code IS NOT NULL""")
oracle("s7_unique_sequence_match", """SELECT CAST(doc_id AS VARCHAR) AS rna_id, CAST(m AS VARCHAR) AS match_id FROM documents
   LEFT JOIN (SELECT text, min(doc_id) AS m FROM documents GROUP BY 1 HAVING count(*)=1) u USING (text)""")
