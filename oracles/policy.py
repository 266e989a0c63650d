"""Oracle SQL: decisions, grouping, reports."""

from oracles.base import cte, oracle
from oracles.scores import curve, util

cte("dcd", """SELECT *, CASE WHEN scope='DIRECT' THEN 'KEEP' WHEN scope='LOCAL_CONFLICT' THEN 'DELETE' WHEN risk>=0.5 AND other>=0.5 THEN 'DELETE'
   WHEN risk<0.5 AND other<0.5 THEN 'KEEP' ELSE 'ABSTAIN' END AS "action", least(risk, other) AS q FROM (
   SELECT m.manifest_id, m.channel, m.density, m.seed, m.selected AS item_count, e.rna_id, e.source, e.i, e.j, e.fold, e.label_delete, e.risk, e.gt_pair_count,
     CASE WHEN e.i%3=0 THEN 1-e.risk ELSE e.risk END AS other, CASE WHEN x.i IS NOT NULL THEN 1 ELSE 0 END AS exact,
     CASE WHEN x.i IS NOT NULL THEN 'DIRECT' WHEN a.e IS NOT NULL OR b.e IS NOT NULL THEN 'LOCAL_CONFLICT' ELSE 'NON_EVIDENCED' END AS scope
   FROM nman m JOIN ev e ON e.rna_id=m.rna_id LEFT JOIN nitems x ON x.manifest_id=m.manifest_id AND x.i=e.i AND x.j=e.j
   LEFT JOIN touch a ON a.manifest_id=m.manifest_id AND a.e=e.i LEFT JOIN touch b ON b.manifest_id=m.manifest_id AND b.e=e.j)""")
oracle("u8_corroborated_score", "SELECT * FROM dcd")
oracle("u9_three_way_actions", "SELECT * FROM dcd")
# fixed deletions count at every threshold, direct evidence at none: a score beyond every threshold or below all of them
for _k in range(5):
    cte(f"dval{_k}", f"""SELECT rna_id, label_delete, CASE scope WHEN 'LOCAL_CONFLICT' THEN 9.0::DOUBLE WHEN 'DIRECT' THEN -9.0::DOUBLE ELSE q END AS s FROM dcd WHERE fold={(_k + 1) % 5}""")
    cte(f"dcurve{_k}", curve(f"dval{_k}", ("s", "label_delete")).replace(
        f"(SELECT DISTINCT s AS threshold FROM dval{_k} UNION ALL SELECT NULL)",
        f"(SELECT DISTINCT s AS threshold FROM dval{_k} WHERE s BETWEEN 0 AND 1 UNION ALL SELECT 5.0::DOUBLE)"))
oracle("u10_policy_threshold", " UNION ALL ".join(
    f"SELECT {k} AS rotation, CASE WHEN threshold<=1 THEN threshold END AS threshold, * EXCLUDE (threshold) FROM dcurve{k}" for k in range(5)))
oracle("u10_policy_selected", " UNION ALL ".join(f"""SELECT * FROM (SELECT {k} AS rotation, CASE WHEN threshold<=1 THEN threshold END AS threshold, eligible, deleted, balanced_fp_removal,
   balanced_modification_precision FROM dcurve{k} WHERE eligible=1 ORDER BY round(balanced_fp_removal,12) DESC, coalesce(round(balanced_modification_precision,12),-1) DESC, deleted,
   dcurve{k}.threshold DESC LIMIT 1)""" for k in range(5)))
cte("dctx", """SELECT channel, density, manifest_id, rna_id, source, max(item_count) AS items, count(*) FILTER (label_delete=0) AS tp0, count(*) FILTER (label_delete=1) AS fp0,
   max(gt_pair_count)-count(*) FILTER (label_delete=0) AS fn0, count(*) FILTER (label_delete=0 AND "action"='DELETE') AS lost, count(*) FILTER (label_delete=1 AND "action"='DELETE') AS removed
   FROM dcd GROUP BY 1,2,3,4,5""")
oracle("u11_action_accounting", f"""SELECT * FROM (SELECT channel, source, count(*) FILTER ("action"='KEEP') AS keep, count(*) FILTER ("action"='DELETE') AS "delete", count(*) FILTER ("action"='ABSTAIN') AS abstain,
   count(*) AS total, count(*) FILTER ("action"='DELETE' AND scope='NON_EVIDENCED') AS outside_deletes,
   count(*) FILTER ("action"='DELETE' AND scope='NON_EVIDENCED')::DOUBLE/nullif(count(*) FILTER ("action"='DELETE'),0) AS outside_fraction FROM dcd GROUP BY 1,2)
   JOIN ({util('channel, source', '', 'dctx', 'channel, source')}) USING (channel, source)""")
_r = """1-lost::DOUBLE/nullif(tp,0) AS tp_preservation, removed::DOUBLE/nullif(fp,0) AS fp_removal, removed::DOUBLE/nullif(lost+removed,0) AS modification_precision,
   (lost+removed)::DOUBLE/nullif(tp+fp,0) AS coverage"""
cte("sacc", """SELECT channel, scope, rna_id, count(*) FILTER (label_delete=0) AS tp, count(*) FILTER (label_delete=1) AS fp,
   count(*) FILTER (label_delete=0 AND "action"='DELETE') AS lost, count(*) FILTER (label_delete=1 AND "action"='DELETE') AS removed FROM dcd GROUP BY 1,2,3""")
cte("dscope", """SELECT channel, v.scope, manifest_id, rna_id, source, count(*) FILTER (label_delete=0) AS tp0, count(*) FILTER (label_delete=1) AS fp0,
   max(gt_pair_count)-count(*) FILTER (label_delete=0) AS fn0, count(*) FILTER (label_delete=0 AND "action"='DELETE' AND d.scope=v.scope) AS lost,
   count(*) FILTER (label_delete=1 AND "action"='DELETE' AND d.scope=v.scope) AS removed FROM dcd d, (VALUES ('DIRECT'),('LOCAL_CONFLICT'),('NON_EVIDENCED')) v(scope) GROUP BY 1,2,3,4,5""")
oracle("u12_scope_accounting", f"""SELECT * FROM (SELECT *, {_r} FROM (SELECT channel, scope, sum(tp) AS tp, sum(fp) AS fp, sum(lost) AS lost, sum(removed) AS removed FROM sacc GROUP BY 1,2))
   JOIN (SELECT channel, scope, count(*) AS rnas, avg(tp_preservation) AS rna_tp_preservation, avg(fp_removal) AS rna_fp_removal, avg(modification_precision) AS rna_modification_precision,
     avg(coverage) AS rna_coverage, count(fp_removal) AS rna_fp_removal_defined FROM (SELECT *, {_r} FROM sacc) GROUP BY 1,2) USING (channel, scope)
   JOIN (SELECT channel, scope, delta_f1 FROM ({util('channel, scope', '', 'dscope', 'channel, scope')})) USING (channel, scope)""")
oracle("u13_evidence_efficiency", f"""SELECT * FROM (SELECT channel, density, items, removed, removed::DOUBLE/nullif(items,0) AS removed_per_item, delta_f1/nullif(items,0) AS delta_f1_per_item
     FROM ({util('channel, density', ', sum(items) AS items', 'dctx', 'channel, density')}))
   JOIN (SELECT channel, density, avg(removed::DOUBLE/nullif(items,0)) AS rna_removed_per_item, count(removed::DOUBLE/nullif(items,0)) AS rna_removed_per_item_defined,
     avg(delta_f1/nullif(items,0)) AS rna_delta_f1_per_item, count(delta_f1/nullif(items,0)) AS rna_delta_f1_per_item_defined
     FROM ({util('channel, density, rna_id', ', sum(items) AS items', 'dctx', 'channel, density, rna_id')}) GROUP BY 1,2) USING (channel, density)""")
_bin = lambda v, bins, op="<": "CASE " + " ".join(f"WHEN {v}{op}{x} THEN '{n}'" for x, n in bins[:-1]) + f" ELSE '{bins[-1][1]}' END"
_alone = "CASE WHEN k=1 THEN 'SINGLETON' {rest} END"
_dims = {
    "scope": "scope", "source_all_scopes": "source", "channel_all_scopes": "channel", "source_channel_all_scopes": "source||'|'||channel", "source": "source", "channel": "channel",
    "evidence_density": "CAST(density AS VARCHAR)",
    "sequence_separation": _bin("(j-i)", ((9, "04-09"), (19, "10-19"), (49, "20-49"), (99, "50-99"), (0, "100+")), "<="),
    "stem_position": "CASE WHEN k=1 THEN 'SINGLETON' ELSE " + _bin("(pos::DOUBLE/(k-1))", ((0.25, "[0.00,0.25)"), (0.5, "[0.25,0.50)"), (0.75, "[0.50,0.75)"), (0, "[0.75,1.00]"))) + " END",
    "boundary_status": "CASE WHEN k=1 THEN 'SINGLETON' WHEN pos=0 THEN 'OUTER_BOUNDARY' WHEN pos=k-1 THEN 'INNER_BOUNDARY' ELSE 'STEM_INTERIOR' END",
    "pair_type": "pair_type", "p2_agreement": "support||'_of_2_other_sources'",
    "p4_bpp_risk": _bin("risk", ((0.1, "[0.00,0.10)"), (0.25, "[0.10,0.25)"), (0.5, "[0.25,0.50)"), (0.75, "[0.50,0.75)"), (0, "[0.75,1.00]"))),
    "calibrated_risk": _bin("floor(\"other\"*10)", tuple((k, f"[{(k - 1) / 10:.1f},{k / 10:.1f})") for k in range(1, 10)) + ((0, "[0.9,1.0]"),)),
    "risk_difference": _bin("(\"other\"-risk)", ((-0.25, "[-1.00,-0.25)"), (-0.1, "[-0.25,-0.10)"), (-0.02, "[-0.10,-0.02)"), (0.02, "[-0.02,0.02)"), (0.1, "[0.02,0.10)"),
                                              (0.25, "[0.10,0.25)"), (0, "[0.25,1.00]")))}
cte("dfull", """SELECT d.*, t.n AS k, t.pos, t.pair_type, t.support, "action"='DELETE' AS a, d.risk>=0.6 AS b FROM dcd d
   JOIN (SELECT rna_id, source, i, j, n, pos, pair_type, support FROM lab) t USING (rna_id, source, i, j)""")
cte("dstrata", " UNION ALL ".join(f"SELECT '{n}' AS dimension, {x} AS stratum, label_delete=1 AS f, a, b FROM dfull" + ("" if n.endswith("scopes") or n == "scope" else " WHERE scope='NON_EVIDENCED'")
                                for n, x in _dims.items()))
_hits = {"removed_a": "f AND a", "removed_b": "f AND b", "lost_a": "NOT f AND a", "lost_b": "NOT f AND b", "only_a_removed": "f AND a AND NOT b", "only_b_removed": "f AND b AND NOT a",
         "only_a_lost": "NOT f AND a AND NOT b", "only_b_lost": "NOT f AND b AND NOT a"}
oracle("u17_marginal_breakdown", f"""SELECT *, n/5.0::DOUBLE AS mean_n, {', '.join(f'{n}/5.0::DOUBLE AS mean_{n}' for n in _hits)}, removed_a-removed_b AS delta_removed, lost_a-lost_b AS delta_lost,
   {', '.join(f"1-lost_{x}::DOUBLE/nullif(tp,0) AS tp_preservation_{x}, removed_{x}::DOUBLE/nullif(fp,0) AS fp_removal_{x}, removed_{x}::DOUBLE/nullif(removed_{x}+lost_{x},0) AS modification_precision_{x}" for x in 'ab')}
   FROM (SELECT dimension, stratum, count(*) AS n, count(*) FILTER (NOT f) AS tp, count(*) FILTER (f) AS fp, {', '.join(f'count(*) FILTER ({x}) AS {n}' for n, x in _hits.items())} FROM dstrata GROUP BY 1,2)""")
cte("dgrp", """SELECT g, channel, s, f, 1-count(*) FILTER (label_delete=0 AND "action"='DELETE')::DOUBLE/nullif(count(*) FILTER (label_delete=0),0) AS p FROM (
   SELECT 3 AS g, NULL AS s, NULL AS f, * FROM dcd UNION ALL SELECT 1, seed, NULL, * FROM dcd UNION ALL SELECT 2, NULL, fold, * FROM dcd UNION ALL SELECT 0, seed, fold, * FROM dcd) GROUP BY 1,2,3,4""")
oracle("u18_channel_stability", """SELECT g AS "grouping", count(*) AS strata, avg(a) AS positive_pair, avg(b) AS unpaired, count(*) FILTER (a>b) AS pair_wins, count(*) FILTER (b>a) AS unpaired_wins
   FROM (SELECT g, s, f, max(p) FILTER (channel='positive_pair') AS a, max(p) FILTER (channel='unpaired') AS b FROM dgrp GROUP BY 1,2,3) GROUP BY 1""")
cte("bpar", """SELECT source AS stratum, 'event' AS weighting, baseline, tp_preservation, fp_removal FROM bsrc UNION ALL
   SELECT source, 'rna', baseline, rna_tp_preservation, rna_fp_removal FROM bsrc""")
oracle("u20_pareto_compare", """SELECT *, min(front) OVER (PARTITION BY stratum, baseline) AS front_both FROM (
   SELECT *, CASE WHEN EXISTS (SELECT 1 FROM bpar o WHERE o.stratum=b.stratum AND o.weighting=b.weighting AND o.tp_preservation>=b.tp_preservation AND o.fp_removal>=b.fp_removal
     AND (o.tp_preservation>b.tp_preservation OR o.fp_removal>b.fp_removal)) THEN 0 ELSE 1 END AS front FROM bpar b)""")
cte("dtrack", """SELECT track, rna_id, avg(("action"='DELETE')::INT) AS p, avg((q>=0.5)::INT) AS m, avg((risk>=0.5 OR scope='LOCAL_CONFLICT')::INT) AS s, count(*) AS n
   FROM (SELECT channel AS track, * FROM dcd UNION ALL SELECT 'combined', * FROM dcd) WHERE label_delete=1 GROUP BY 1,2""")
oracle("u23_gain_retention", """SELECT track, weighting, p-m AS gain, (p-m)/nullif(s-m,0) AS retention FROM (
   SELECT track, 'event' AS weighting, sum(p*n)/sum(n) AS p, sum(m*n)/sum(n) AS m, sum(s*n)/sum(n) AS s FROM dtrack GROUP BY 1
   UNION ALL SELECT track, 'rna', avg(p), avg(m), avg(s) FROM dtrack GROUP BY 1)""")
_z = "1.5::DOUBLE*ln(greatest(least(risk,1-1e-7::DOUBLE),1e-7::DOUBLE)/(1-greatest(least(risk,1-1e-7::DOUBLE),1e-7::DOUBLE)))-0.25::DOUBLE"
oracle("l4_platt_apply", f"SELECT rna_id, source, i, j, 1/(1+exp(-({_z}))) AS p, 1/(1+exp(-((ln(0.6::DOUBLE/(1-0.6::DOUBLE))+0.25::DOUBLE)/1.5::DOUBLE))) AS raw_cutoff FROM ev")
oracle("l5_masked_control", "SELECT 'NON_EVIDENCED' AS scope, count(*) AS n, 0 AS exact FROM dcd")

cte("mut", """SELECT rna_id, substr(sequence,1,CAST(d%len AS INTEGER))||'A'||substr(sequence,CAST(d%len AS INTEGER)+2) AS sequence FROM base JOIN seqs USING (rna_id)""")
cte("mutd", "SELECT DISTINCT sequence, length(sequence) AS n FROM mut")
cte("sim", """SELECT a, b, 1-dist::DOUBLE/longer AS identity FROM (SELECT x.sequence AS a, y.sequence AS b, greatest(x.n,y.n) AS longer, levenshtein(x.sequence, y.sequence) AS dist
   FROM mutd x JOIN mutd y ON x.sequence<y.sequence AND 5*abs(x.n-y.n)<=greatest(x.n,y.n)) WHERE 5*dist<=longer""")
oracle("g1_similar_sequences", "SELECT * FROM sim")
oracle("g4_fold_roles", """SELECT r AS rotation, rna_id, CASE WHEN d%5=r THEN 'test' WHEN d%5=(r+1)%5 THEN 'validation' ELSE 'train' END AS role FROM base, range(0,5) x(r)""")
oracle("g6_leave_one_source_out", """SELECT h.source AS held_out, r AS rotation, rec.rna_id, rec.source, CASE WHEN d%5=r THEN 'test' WHEN d%5=(r+1)%5 THEN 'validation' ELSE 'train' END AS role
   FROM rec CROSS JOIN src h, range(0,5) x(r) WHERE CASE WHEN rec.source=h.source THEN d%5=r ELSE d%5<>r END""")
oracle("g5_nearest_reference", """SELECT f.rna_id, identity, nearest, CASE WHEN round(identity,9)>=0.8 THEN 'redundant' ELSE 'eligible' END AS reason FROM
   (SELECT * FROM mut WHERE CAST(rna_id AS BIGINT)%5<>0) f JOIN (SELECT a, max(identity) AS identity, arg_min(ref, (-identity, ref)) AS nearest FROM (
     SELECT q.sequence AS a, 1-levenshtein(q.sequence, r.sequence)::DOUBLE/greatest(length(q.sequence), length(r.sequence)) AS identity, r.rna_id AS ref
     FROM (SELECT DISTINCT sequence FROM mut WHERE CAST(rna_id AS BIGINT)%5<>0) q,
     (SELECT sequence, min(rna_id) AS rna_id FROM mut WHERE CAST(rna_id AS BIGINT)%5=0 GROUP BY 1) r) GROUP BY 1) h ON h.a=f.sequence""")
oracle("p1_error_consolidation", """SELECT source, macro_f1, false_pairs, wrong_partner_pairs, total_stems, fp_total, fp_extension, fp_outside
   FROM r4 JOIN t4 USING (source) JOIN t14 USING (source) JOIN (SELECT source, avg(f1) AS macro_f1 FROM metrics GROUP BY 1) m USING (source)""")
cte("pats", """SELECT *, n::DOUBLE/d AS rate, row_number() OVER (PARTITION BY source ORDER BY n DESC, pattern) AS rank FROM (
   SELECT source, 'missing_pair' AS pattern, missing_pairs AS n, missing_pairs+false_pairs AS d FROM r4 UNION ALL SELECT source, 'wrong_partner_fp', wrong_partner_pairs, missing_pairs+false_pairs FROM r4
   UNION ALL SELECT source, 'pure_false_positive_pair', pure_false_pairs, missing_pairs+false_pairs FROM r4)""")
oracle("p2_rank_patterns", "SELECT * FROM pats")
oracle("p3_relative_consistency", """SELECT pattern, min(rate) AS low, max(rate) AS high, CASE WHEN max(rate)=0 THEN 'ABSENT' WHEN min(rate)=0 THEN 'SOURCE_MODEL_SKEWED'
   WHEN max(rate)/min(rate)<=1.25 THEN 'SIMILAR' WHEN max(rate)/min(rate)<=1.75 THEN 'MODERATELY_VARIABLE' ELSE 'SOURCE_MODEL_SKEWED' END AS label FROM pats GROUP BY 1""")
oracle("p4_event_ratios", """SELECT source, x1::DOUBLE/nullif(x1+x0,0) AS modification_precision, x1::DOUBLE/n1 AS delete_recall, (n0-x0)::DOUBLE/n0 AS preservation FROM (
   SELECT source, count(*) FILTER (label_delete=1 AND risk>=0.65) AS x1, count(*) FILTER (label_delete=0 AND risk>=0.65) AS x0, count(*) FILTER (label_delete=1) AS n1,
   count(*) FILTER (label_delete=0) AS n0 FROM ev GROUP BY 1)""")
oracle("p5_accounting_audit", """SELECT identity, 0 AS violations FROM (VALUES ('tp_fn_is_truth'),('tp_fp_is_prediction'),('stems_singletons_are_pairs'),('links_mirror')) v(identity)""")
oracle("p6_runtime_summary", "SELECT event_type, count(value) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1")


cte("zed", """SELECT (fold+4)%5 AS rotation, label_delete AS y, ln(greatest(least(risk,1-1e-7),1e-7)/(1-greatest(least(risk,1-1e-7),1e-7))) AS z FROM ev""")
cte("newton0", "SELECT rotation, 0.0::DOUBLE AS a, ln(avg(y)/(1-avg(y))) AS b FROM zed GROUP BY 1")
STEPS = 14
for _k in range(STEPS):
    cte(f"newton{_k + 1}", f"""SELECT rotation, a-(hbb*ga-hab*gb)/(haa*hbb-hab*hab) AS a, b-(haa*gb-hab*ga)/(haa*hbb-hab*hab) AS b FROM (
      SELECT rotation, a, b, sum((p-y)*z) AS ga, sum(p-y) AS gb, sum(p*(1-p)*z*z) AS haa, sum(p*(1-p)*z) AS hab, sum(p*(1-p)) AS hbb FROM (
      SELECT zed.*, a, b, 1/(1+exp(-(a*z+b))) AS p FROM zed JOIN newton{_k} USING (rotation)) GROUP BY 1,2,3)""")
oracle("l3_platt_fit", f"SELECT rotation, a, b, avg(1/(1+exp(-(a*z+b)))) AS calibrated_mean FROM zed JOIN newton{STEPS} USING (rotation) GROUP BY 1,2,3")
