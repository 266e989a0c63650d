"""Oracle SQL: exact comparison, pair errors, separation, stems."""

from oracles.base import cte, oracle, prf

oracle("e1_pair_status", "SELECT * FROM status")
oracle("e2_pair_metrics", "SELECT * FROM metrics")

# a pair is a singleton when neither stacked neighbour exists
cte("tsingle", """SELECT t.* FROM truth t WHERE NOT EXISTS (SELECT 1 FROM truth o WHERE o.rna_id=t.rna_id
   AND ((o.i=t.i-1 AND o.j=t.j+1) OR (o.i=t.i+1 AND o.j=t.j-1)))""")
cte("psingle", """SELECT t.* FROM pred t WHERE NOT EXISTS (SELECT 1 FROM pred o WHERE o.rna_id=t.rna_id AND o.source=t.source
   AND ((o.i=t.i-1 AND o.j=t.j+1) OR (o.i=t.i+1 AND o.j=t.j-1)))""")
oracle("e3_prf_nullable", """SELECT rna_id, source, p AS precision, r AS recall,
   CASE WHEN p+r > 0 THEN 2*p*r/(p+r) END AS f1 FROM (
   SELECT rna_id, source, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) END AS p, CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) END AS r
   FROM (SELECT rec.rna_id, rec.source, count(*) FILTER (in_t AND in_p) AS tp, count(*) FILTER (in_p AND NOT in_t) AS fp,
     count(*) FILTER (in_t AND NOT in_p) AS fn
     FROM rec LEFT JOIN (SELECT rna_id, source, i, j, bool_or(k='t') AS in_t, bool_or(k='p') AS in_p FROM (
        SELECT rna_id, source, i, j, 't' AS k FROM tsingle CROSS JOIN src UNION ALL SELECT rna_id, source, i, j, 'p' FROM psingle)
        GROUP BY ALL) x USING (rna_id, source) GROUP BY 1,2))""")
oracle("e4_summary_by_source", f"""SELECT source, n_samples, sum_tp, sum_fp, sum_fn, macro_precision, macro_recall, macro_f1,
   precision AS micro_precision, recall AS micro_recall, f1 AS micro_f1, median_f1, std_f1, min_f1, max_f1
   FROM (SELECT *, {prf('sum_tp','sum_fp','sum_fn')} FROM (SELECT source, count(*) AS n_samples, sum(tp) AS sum_tp, sum(fp) AS sum_fp,
     sum(fn) AS sum_fn, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
     quantile_cont(f1, 0.5) AS median_f1, stddev_pop(f1) AS std_f1, min(f1) AS min_f1, max(f1) AS max_f1 FROM metrics GROUP BY 1))""")
_pairs = "coalesce(string_agg(i||'-'||j, ',' ORDER BY i, j) FILTER (status='{}'), '') AS {}_pairs"
oracle("e5_partition_export", f"""SELECT rec.rna_id, rec.source, {_pairs.format('TP','tp')}, {_pairs.format('FP','fp')},
   {_pairs.format('FN','fn')} FROM rec LEFT JOIN status USING (rna_id, source) GROUP BY 1,2""")


def _decoded(cutoff: str) -> str:
    return f"""SELECT rna_id, source, tp, fp, fn, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END AS precision,
   CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END AS recall, CASE WHEN tp>0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END AS f1
   FROM (SELECT rec.rna_id, rec.source, count(*) FILTER (label_delete=0) AS tp, count(*) FILTER (label_delete=1) AS fp,
     any_value(n.n) - count(*) FILTER (label_delete=0) AS fn
     FROM rec JOIN (SELECT rna_id, count(*) AS n FROM truth GROUP BY 1) n USING (rna_id)
     LEFT JOIN (SELECT * FROM ev WHERE 1-risk > {cutoff}) e USING (rna_id, source) GROUP BY 1,2)"""


oracle("e6_threshold_decode_metrics", _decoded("0.5"))
oracle("e7_metric_reproduction", f"""SELECT source, count(*) AS n, count(*) FILTER (pe) AS precision_equal, count(*) FILTER (re) AS recall_equal,
   count(*) FILTER (fe) AS f1_equal, count(*) FILTER (pe AND re AND fe) AS all_equal, count(*) FILTER (miss) AS unmatched FROM (
   SELECT source, round(m.precision,4)=round(o.precision,4) AS pe, round(m.recall,4)=round(o.recall,4) AS re,
     round(m.f1,4)=round(o.f1,4) AS fe, m.f1 IS NULL OR o.f1 IS NULL AS miss
   FROM (SELECT * FROM metrics WHERE f1 > 0) m FULL JOIN ({_decoded('0.4')}) o USING (rna_id, source)) GROUP BY 1""")
oracle("e8_strata_metrics", """SELECT level, value, count(*) FILTER (label_delete=0) AS tp, count(*) FILTER (label_delete=1) AS fp,
   avg(1-label_delete) AS precision, avg(risk) AS mean_risk FROM (
   SELECT 'pooled' AS level, 'all' AS value, * FROM ev UNION ALL SELECT 'source', source, * FROM ev
   UNION ALL SELECT 'fold', CAST(fold AS VARCHAR), * FROM ev UNION ALL SELECT 'partition', "partition", * FROM ev) GROUP BY 1,2""")

cte("tend", "SELECT rna_id, i AS e, j AS partner FROM truth UNION ALL SELECT rna_id, j, i FROM truth")
cte("pend", "SELECT rna_id, source, i AS e, j AS partner FROM pred UNION ALL SELECT rna_id, source, j, i FROM pred")
cte("fpann", """SELECT f.rna_id, f.source, f.i, f.j, count(te.e) AS degree,
   coalesce(string_agg(CAST(te.e AS VARCHAR), ',' ORDER BY te.e), '') AS endpoints,
   coalesce(string_agg(DISTINCT least(te.e,te.partner)||'-'||greatest(te.e,te.partner), ','), '') AS links_raw
   FROM status f LEFT JOIN tend te ON te.rna_id=f.rna_id AND te.e IN (f.i, f.j) WHERE f.status='FP' GROUP BY 1,2,3,4""")
cte("fnann", """SELECT f.rna_id, f.source, f.i, f.j, count(pe.e) AS degree,
   coalesce(string_agg(CAST(pe.e AS VARCHAR), ',' ORDER BY pe.e), '') AS endpoints,
   coalesce(string_agg(DISTINCT least(pe.e,pe.partner)||'-'||greatest(pe.e,pe.partner), ','), '') AS links_raw
   FROM status f LEFT JOIN pend pe ON pe.rna_id=f.rna_id AND pe.source=f.source AND pe.e IN (f.i, f.j) WHERE f.status='FN' GROUP BY 1,2,3,4""")
# at most two links; order them by their first coordinate
_links = """CASE WHEN position(',' IN links_raw)=0 THEN links_raw
   WHEN CAST(split_part(split_part(links_raw,',',1),'-',1) AS INT) < CAST(split_part(split_part(links_raw,',',2),'-',1) AS INT) THEN links_raw
   ELSE split_part(links_raw,',',2)||','||split_part(links_raw,',',1) END AS links"""
oracle("r1_wrong_partner_events", f"SELECT rna_id, source, i, j, degree, endpoints, {_links} FROM fpann WHERE degree > 0")
oracle("r2_missing_pair_annotations", f"SELECT rna_id, source, i, j, degree, endpoints, {_links} FROM fnann")
oracle("r3_pair_error_table", f"""SELECT rna_id, source, 'false_positive_pair' AS error_type, i, j, CASE WHEN degree>0 THEN 1 ELSE 0 END AS wrong_partner,
   degree, {_links} FROM fpann UNION ALL SELECT rna_id, source, 'missing_pair', i, j, CASE WHEN degree>0 THEN 1 ELSE 0 END, degree, {_links} FROM fnann""")
cte("r4", """SELECT n.source, n_samples, missing_pairs, false_pairs, wrong_partner_pairs, pure_false_pairs, linked_missing_pairs,
   pure_missing_pairs, degree1, degree2, samples_with_wrong_partner
   FROM (SELECT source, count(*) AS n_samples FROM rec GROUP BY 1) n
   JOIN (SELECT source, count(*) AS false_pairs, count(*) FILTER (degree>0) AS wrong_partner_pairs, count(*) FILTER (degree=0) AS pure_false_pairs,
     count(*) FILTER (degree=1) AS degree1, count(*) FILTER (degree=2) AS degree2,
     count(DISTINCT CASE WHEN degree>0 THEN rna_id END) AS samples_with_wrong_partner FROM fpann GROUP BY 1) f USING (source)
   JOIN (SELECT source, count(*) AS missing_pairs, count(*) FILTER (degree>0) AS linked_missing_pairs,
     count(*) FILTER (degree=0) AS pure_missing_pairs FROM fnann GROUP BY 1) m USING (source)""")
oracle("r4_pair_error_summary", "SELECT * FROM r4")

BIN = ("CASE WHEN rel <= 0.25 THEN 'relative_q00_q25' WHEN rel <= 0.5142857142857142::DOUBLE THEN 'relative_q25_q50' "
       "WHEN rel <= 0.8::DOUBLE THEN 'relative_q50_q75' WHEN rel <= 0.9333333333333333::DOUBLE THEN 'relative_q75_q90' "
       "ELSE 'relative_q90_q100_long_range' END")
cte("tsep", "SELECT t.*, j-i AS sep, CAST(j-i AS DOUBLE)/(len-1) AS rel FROM truth t JOIN base USING (rna_id)")
cte("ssep", "SELECT st.*, j-i AS sep, CAST(j-i AS DOUBLE)/(len-1) AS rel FROM status st JOIN base USING (rna_id)")
cte("sbin", f"SELECT *, {BIN} AS bin FROM ssep")
cte("bins", """SELECT * FROM (VALUES ('relative_q00_q25'),('relative_q25_q50'),('relative_q50_q75'),('relative_q75_q90'),
   ('relative_q90_q100_long_range')) v(bin) CROSS JOIN src""")
oracle("d1_pair_separation", "SELECT rna_id, i, j, sep AS separation, rel AS relative_separation FROM tsep")
oracle("d2_separation_bins", f"SELECT {BIN} AS bin, count(*) AS pairs FROM tsep GROUP BY 1")
cte("levels", "SELECT * FROM (VALUES (0.0),(0.1),(0.25),(0.5),(0.75),(0.9),(0.95),(1.0)) v(level)")
_q = "[0.0,0.1,0.25,0.5,0.75,0.9,0.95,1.0]"
oracle("d3_separation_quantiles", f"""SELECT variable, unnest({_q}) AS level, unnest(q) AS quantile FROM (
   SELECT 'raw' AS variable, quantile_cont(CAST(sep AS DOUBLE), {_q}) AS q FROM tsep UNION ALL
   SELECT 'relative', quantile_cont(rel, {_q}) FROM tsep)""")
oracle("d3_price_quantiles", f"""SELECT flag, unnest({_q}) AS level, unnest(q) AS quantile FROM (
   SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, {_q}) AS q FROM lineitem GROUP BY 1)""")
cte("cuts", "SELECT quantile_cont(CAST(sep AS DOUBLE), [0.25,0.5,0.75,0.9]) AS r, quantile_cont(rel, [0.25,0.5,0.75,0.9]) AS l FROM tsep")
oracle("d4_candidate_binnings", """SELECT definition, bin_index, count(*) AS pair_count, count(DISTINCT rna_id) AS rna_count FROM (
   SELECT 'raw' AS definition, rna_id, (sep>r[1])::INT+(sep>r[2])::INT+(sep>r[3])::INT+(sep>r[4])::INT AS bin_index FROM tsep CROSS JOIN cuts
   UNION ALL SELECT 'relative', rna_id, (rel>l[1])::INT+(rel>l[2])::INT+(rel>l[3])::INT+(rel>l[4])::INT FROM tsep CROSS JOIN cuts
   UNION ALL SELECT 'hybrid_long_range', rna_id, (rel>l[4] AND sep>r[2])::INT FROM tsep CROSS JOIN cuts) GROUP BY 1,2""")
oracle("d5_pair_inventory", """SELECT rna_id, source, role, i, j, status, sep AS separation, rel AS relative_separation, bin FROM sbin,
   (VALUES ('truth'),('prediction')) v(role) WHERE (role='truth' AND status IN ('TP','FN')) OR (role='prediction' AND status IN ('TP','FP'))""")
cte("dbin", f"""SELECT *, {prf('tp','fp','fn')},
   fp::DOUBLE/sum(fp) OVER (PARTITION BY source) AS fp_share, fn::DOUBLE/sum(fn) OVER (PARTITION BY source) AS fn_share FROM (
   SELECT b.source, b.bin, count(*) FILTER (status='TP') AS tp, count(*) FILTER (status='FP') AS fp, count(*) FILTER (status='FN') AS fn
   FROM bins b LEFT JOIN sbin x ON x.source=b.source AND x.bin=b.bin GROUP BY 1,2)""")
oracle("d6_errors_by_separation", "SELECT * FROM dbin")
oracle("d7_wrong_partner_by_separation", """SELECT *, CASE WHEN fp>0 THEN wrong_partner::DOUBLE/fp ELSE 0 END AS wrong_share_in_bin,
   wrong_partner::DOUBLE/sum(wrong_partner) OVER (PARTITION BY source) AS wrong_share_of_source,
   pure_fp::DOUBLE/sum(pure_fp) OVER (PARTITION BY source) AS pure_share_of_source FROM (
   SELECT b.source, b.bin, count(x.i) AS fp, count(*) FILTER (degree>0) AS wrong_partner, count(*) FILTER (degree=0) AS pure_fp
   FROM bins b LEFT JOIN (SELECT sbin.*, degree FROM sbin JOIN fpann USING (rna_id, source, i, j)) x
   ON x.source=b.source AND x.bin=b.bin GROUP BY 1,2)""")

# stems by walking inward from pairs without an outer neighbour
cte("allp", "SELECT rna_id, 'truth' AS source, i, j FROM truth UNION ALL SELECT rna_id, source, i, j FROM pred")
cte("walk", """SELECT a.rna_id, a.source, a.i AS oi, a.j AS oj, a.i, a.j, 1 AS n FROM allp a ANTI JOIN
     (SELECT rna_id, source, i+1 AS i, j-1 AS j FROM allp) o ON o.rna_id=a.rna_id AND o.source=a.source AND o.i=a.i AND o.j=a.j
   UNION ALL SELECT w.rna_id, w.source, w.oi, w.oj, a.i, a.j, w.n+1 FROM walk w JOIN allp a
     ON a.rna_id=w.rna_id AND a.source=w.source AND a.i=w.i+1 AND a.j=w.j-1""")
cte("chain", "SELECT rna_id, source, oi, oj, max(n) AS n, max(i) AS li, min(j) AS rj FROM walk GROUP BY 1,2,3,4")
cte("stem", "SELECT rna_id, source, oi AS ls, li AS le, rj AS rs, oj AS re, n FROM chain WHERE n >= 2")
oracle("t1_strict_stems", """SELECT c.rna_id, c.source, oi AS left_start, li AS left_end, rj AS right_start, oj AS right_end, n AS n_pairs,
   (SELECT string_agg((oi+k)||'-'||(oj-k), ',' ORDER BY k) FROM range(0, 200) r(k) WHERE k < n) AS pairs
   FROM chain c WHERE n >= 2 AND source <> 'truth'""")
oracle("t2_singleton_pairs", "SELECT rna_id, source, i, j FROM psingle")
cte("structs", "SELECT rna_id, source FROM rec UNION ALL SELECT rna_id, 'truth' FROM base")
oracle("t3_stem_inventory", """SELECT s.rna_id, s.source, coalesce(sum(n),0) AS pair_count, count(*) FILTER (n>=2) AS stem_count,
   coalesce(sum(n) FILTER (n>=2),0) AS stem_pair_count, count(*) FILTER (n=1) AS singleton_count,
   coalesce(avg(n) FILTER (n>=2),0) AS mean_length, coalesce(quantile_cont(CASE WHEN n>=2 THEN n::DOUBLE END,0.5),0) AS median_length,
   coalesce(max(n) FILTER (n>=2),0) AS max_length, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY oi, oj) FILTER (n>=2),'') AS lengths
   FROM structs s LEFT JOIN chain USING (rna_id, source) GROUP BY 1,2""")
cte("t4", """SELECT s.source, (SELECT count(*) FROM structs x WHERE x.source=s.source) AS n_structures, sum(n) AS total_pairs,
   count(*) FILTER (n>=2) AS total_stems, coalesce(sum(n) FILTER (n>=2),0) AS total_stem_pairs, count(*) FILTER (n=1) AS total_singletons,
   coalesce(sum(n) FILTER (n>=2),0)::DOUBLE/sum(n) AS fraction_in_stems, avg(n) FILTER (n>=2) AS mean_length,
   quantile_cont(CASE WHEN n>=2 THEN n::DOUBLE END, 0.5) AS median_length, max(n) FILTER (n>=2) AS max_length
   FROM chain s GROUP BY 1""")
oracle("t4_stem_summary", "SELECT * FROM t4")
_ov = "greatest(0, least({a}e,{b}e)-greatest({a}s,{b}s)+1)"
cte("relall", f"""SELECT t.rna_id, p.source, t.ls AS t_left_start, t.re AS t_right_end, p.ls AS p_left_start, p.re AS p_right_end,
   t.le AS t_left_end, p.le AS p_left_end, t.n AS tn, p.n AS pn, {_ov.format(a='t.l', b='p.l')} AS left_overlap, {_ov.format(a='t.r', b='p.r')} AS right_overlap,
   CASE WHEN t.ls+t.re = p.ls+p.re THEN {_ov.format(a='t.l', b='p.l')} ELSE 0 END AS pair_overlap,
   (p.ls+p.re)-(t.ls+t.re) AS displacement FROM (SELECT * FROM stem WHERE source='truth') t
   JOIN (SELECT * FROM stem WHERE source<>'truth') p ON t.rna_id=p.rna_id""")
cte("rel", """SELECT *, tn+pn-pair_overlap AS pair_union, least(left_overlap,right_overlap) AS arm, least(tn,pn) AS shorter
   FROM relall WHERE left_overlap>0 OR right_overlap>0""")
oracle("t5_stem_relations", "SELECT * FROM rel")
cte("cand", """SELECT *, count(*) OVER (PARTITION BY rna_id, source, t_left_start, t_right_end) AS t_degree,
   count(*) OVER (PARTITION BY rna_id, source, p_left_start, p_right_end) AS p_degree
   FROM rel WHERE pair_overlap>0 OR (displacement<>0 AND arm>=2 AND arm>=shorter-1)""")
oracle("t6_stem_candidates", "SELECT * FROM cand")
cte("variant", """SELECT v.variant, rel.* FROM rel, (VALUES ('exact_only'),('bilateral_at_least_1'),('bilateral_at_least_2'),
   ('bilateral_2_and_half_shorter'),('bilateral_all_but_one_shorter'),('bilateral_full_shorter')) v(variant)
   WHERE pair_overlap>0 OR (displacement<>0 AND CASE variant WHEN 'exact_only' THEN false WHEN 'bilateral_at_least_1' THEN arm>=1
     WHEN 'bilateral_at_least_2' THEN arm>=2 WHEN 'bilateral_2_and_half_shorter' THEN arm>=2 AND arm*2>=shorter
     WHEN 'bilateral_all_but_one_shorter' THEN arm>=2 AND arm>=shorter-1 ELSE arm>=2 AND arm=shorter END)""")
oracle("t7_stem_candidate_variants", """SELECT e.source, e.variant, edges, t_stems, p_stems, t_multi, p_multi, t_max_degree, p_max_degree
   FROM (SELECT source, variant, count(*) AS edges FROM variant GROUP BY 1,2) e
   JOIN (SELECT source, variant, count(*) AS t_stems, count(*) FILTER (n>1) AS t_multi, max(n) AS t_max_degree FROM
     (SELECT source, variant, rna_id, t_left_start, t_right_end, count(*) AS n FROM variant GROUP BY ALL) GROUP BY 1,2) t USING (source, variant)
   JOIN (SELECT source, variant, count(*) AS p_stems, count(*) FILTER (n>1) AS p_multi, max(n) AS p_max_degree FROM
     (SELECT source, variant, rna_id, p_left_start, p_right_end, count(*) AS n FROM variant GROUP BY ALL) GROUP BY 1,2) p USING (source, variant)""")
# components: transitive closure from every truth stem over tangled edges
cte("tang", "SELECT * FROM cand WHERE t_degree>1 OR p_degree>1")
cte("reach", """SELECT DISTINCT rna_id, source, t_left_start AS ri, t_right_end AS rj, t_left_start AS ti, t_right_end AS tj FROM tang
   UNION SELECT r.rna_id, r.source, r.ri, r.rj, b.t_left_start, b.t_right_end FROM reach r
   JOIN tang a ON a.rna_id=r.rna_id AND a.source=r.source AND a.t_left_start=r.ti AND a.t_right_end=r.tj
   JOIN tang b ON b.rna_id=r.rna_id AND b.source=r.source AND b.p_left_start=a.p_left_start AND b.p_right_end=a.p_right_end""")
cte("label", """SELECT rna_id, source, ti, tj, min((ri, rj)) AS root FROM reach GROUP BY 1,2,3,4""")
cte("comp", """SELECT rna_id, source, ti, tj, 'ambiguous_'||lpad(num,CAST(greatest(3,length(num)) AS INTEGER),'0')
   AS component_id FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY rna_id, source ORDER BY root) AS VARCHAR) AS num FROM label)""")
cte("compmem", """SELECT rna_id, source, component_id, 'truth' AS role, ti AS left_start, tj AS right_end FROM comp
   UNION SELECT a.rna_id, a.source, component_id, 'prediction', p_left_start, p_right_end FROM tang a JOIN comp c
   ON c.rna_id=a.rna_id AND c.source=a.source AND c.ti=a.t_left_start AND c.tj=a.t_right_end""")
oracle("t8_ambiguous_components", "SELECT * FROM compmem")
cte("match", """SELECT *, CASE WHEN state IN ('stem_truncation','stem_extension') THEN
     CASE WHEN t_left_start<>p_left_start AND t_left_end<>p_left_end THEN 'both' WHEN t_left_start<>p_left_start THEN 'outer' ELSE 'inner' END
     ELSE 'none' END AS boundary FROM (
   SELECT *, CASE WHEN displacement=0 AND tn=pn AND pair_overlap=tn THEN 'exact'
     WHEN displacement=0 AND pair_overlap=pn THEN 'stem_truncation' WHEN displacement=0 AND pair_overlap=tn THEN 'stem_extension'
     WHEN pair_overlap=0 AND displacement<>0 THEN 'stem_shift' ELSE 'complex_mismatch' END AS state
   FROM cand WHERE t_degree=1 AND p_degree=1)""")
oracle("t9_stem_matches", "SELECT * FROM match")
cte("resid", """SELECT t.rna_id, src.source, 'stem_missing' AS state, ls AS left_start, le AS left_end, rs AS right_start, re AS right_end, n AS n_pairs
   FROM stem t CROSS JOIN src WHERE t.source='truth' AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.rna_id=t.rna_id AND c.source=src.source
     AND c.t_left_start=t.ls AND c.t_right_end=t.re)
   UNION ALL SELECT p.rna_id, p.source, 'unmatched_predicted_stem', ls, le, rs, re, n FROM stem p WHERE source<>'truth'
     AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.rna_id=p.rna_id AND c.source=p.source AND c.p_left_start=p.ls AND c.p_right_end=p.re)""")
oracle("t10_stem_residuals", "SELECT * FROM resid")
oracle("t11_stem_error_table", """SELECT rna_id, source, state AS event_type, t_left_start||'-'||t_right_end AS truth_outer, p_left_start||'-'||p_right_end AS pred_outer,
     pair_overlap, left_overlap, right_overlap, displacement, boundary, NULL AS component_id FROM match
   UNION ALL SELECT rna_id, source, 'complex_mismatch', CASE WHEN role='truth' THEN left_start||'-'||right_end END,
     CASE WHEN role<>'truth' THEN left_start||'-'||right_end END, NULL, NULL, NULL, NULL, 'none', component_id FROM compmem
   UNION ALL SELECT rna_id, source, state, CASE WHEN state='stem_missing' THEN left_start||'-'||right_end END,
     CASE WHEN state<>'stem_missing' THEN left_start||'-'||right_end END, NULL, NULL, NULL, NULL, 'none', NULL FROM resid""")
# every stem instance with its state
cte("states", """SELECT t.rna_id, src.source, 'truth' AS role, t.ls, t.le, t.rs, t.re, t.n, coalesce(m.state, CASE WHEN c.component_id IS NOT NULL THEN 'ambiguous'
     ELSE 'stem_missing' END) AS state FROM (SELECT * FROM stem WHERE source='truth') t CROSS JOIN src
     LEFT JOIN match m ON m.rna_id=t.rna_id AND m.source=src.source AND m.t_left_start=t.ls AND m.t_right_end=t.re
     LEFT JOIN compmem c ON c.rna_id=t.rna_id AND c.source=src.source AND c.role='truth' AND c.left_start=t.ls AND c.right_end=t.re
   UNION ALL SELECT t.rna_id, t.source, 'prediction', t.ls, t.le, t.rs, t.re, t.n, coalesce(m.state, CASE WHEN c.component_id IS NOT NULL THEN 'ambiguous'
     ELSE 'unmatched_predicted_stem' END) FROM (SELECT * FROM stem WHERE source<>'truth') t
     LEFT JOIN match m ON m.rna_id=t.rna_id AND m.source=t.source AND m.p_left_start=t.ls AND m.p_right_end=t.re
     LEFT JOIN compmem c ON c.rna_id=t.rna_id AND c.source=t.source AND c.role='prediction' AND c.left_start=t.ls AND c.right_end=t.re""")
_tc = "count(*) FILTER (role='truth' AND state='{}') AS {}"
cte("t12", f"""SELECT *, exact::DOUBLE/truth_stems AS fraction_exact, stem_missing::DOUBLE/truth_stems AS fraction_missing,
   unmatched_predicted::DOUBLE/predicted_stems AS fraction_unmatched FROM (SELECT source,
     (SELECT count(*) FROM rec r WHERE r.source=st.source) AS n_samples, count(*) FILTER (role='truth') AS truth_stems,
     count(*) FILTER (role='prediction') AS predicted_stems, {_tc.format('exact','exact')}, {_tc.format('stem_truncation','stem_truncation')},
     {_tc.format('stem_extension','stem_extension')}, {_tc.format('stem_shift','stem_shift')}, {_tc.format('complex_mismatch','isolated_complex_mismatch')},
     {_tc.format('ambiguous','ambiguous_truth_stems')}, count(*) FILTER (role='prediction' AND state='ambiguous') AS ambiguous_predicted_stems,
     (SELECT count(DISTINCT (rna_id, component_id)) FROM comp c WHERE c.source=st.source) AS ambiguous_components,
     {_tc.format('stem_missing','stem_missing')}, count(*) FILTER (state='unmatched_predicted_stem') AS unmatched_predicted FROM states st GROUP BY 1)""")
oracle("t12_stem_error_summary", "SELECT * FROM t12")
oracle("d8_stem_separation_profile", """SELECT source, state, role, count(*) AS stem_count, sum(n) AS stem_pair_count, avg(m) AS mean_raw, quantile_cont(m,0.5) AS median_raw,
   min(m) AS min_raw, max(m) AS max_raw, avg(r) AS mean_relative, quantile_cont(r,0.5) AS median_relative, min(r) AS min_relative, max(r) AS max_relative
   FROM (SELECT source, state, role, n, m, m/(len-1) AS r FROM (SELECT states.*,
     (SELECT quantile_cont(CAST((re-k)-(ls+k) AS DOUBLE), 0.5) FROM range(0,200) x(k) WHERE k<n) AS m FROM states) JOIN base USING (rna_id))
   WHERE state<>'ambiguous' GROUP BY 1,2,3""")
_fc = "count(*) FILTER (fate='{}') AS fp_{}"
cte("t14", f"""SELECT source, count(*) AS fp_total, {', '.join(_fc.format(a, b) for a, b in (('exact','exact'),('stem_truncation','truncation'),
   ('stem_extension','extension'),('stem_shift','shift'),('complex_mismatch','complex'),('ambiguous','ambiguous'),
   ('unmatched_predicted_stem','unmatched'),('outside','outside')))} FROM (
   SELECT f.source, coalesce(s.state,'outside') AS fate FROM status f LEFT JOIN states s ON s.rna_id=f.rna_id AND s.source=f.source
     AND s.role='prediction' AND s.ls+s.re=f.i+f.j AND f.i BETWEEN s.ls AND s.le WHERE f.status='FP') GROUP BY 1""")
oracle("t14_fp_stem_attribution", "SELECT * FROM t14")
