"""Oracle SQL: agreement, rules, reliability, thresholds."""

from oracles.base import cte, oracle, prf
from pairscope.operators.agreement import CATEGORIES, NUMERIC

cte("sup", "SELECT p.*, (SELECT count(*) FROM pred q WHERE q.rna_id=p.rna_id AND q.i=p.i AND q.j=p.j AND q.source<>p.source) AS support FROM pred p")
cte("evs", "SELECT ev.*, support FROM ev JOIN sup USING (rna_id, source, i, j)")
oracle("f1_support_other_count", "SELECT *, 2-support AS support_risk FROM sup")
cte("wpos", """SELECT w.rna_id, w.source, w.i, w.j, w.oi, w.oj, w.n-1 AS pos, c.n FROM walk w JOIN chain c
   ON c.rna_id=w.rna_id AND c.source=w.source AND c.oi=w.oi AND c.oj=w.oj WHERE w.source<>'truth'""")


def _has(di: int, dj: int) -> str:
    return (f"(SELECT count(*) FROM pred q WHERE q.rna_id=w.rna_id AND q.source<>w.source AND q.i=w.i+({di}) AND q.j=w.j+({dj}))")


def _src(s: str) -> str:
    return (f"(SELECT count(*) FROM pred q WHERE q.rna_id=w.rna_id AND q.source='{s}' AND w.source<>'{s}' AND q.i=w.i AND q.j=w.j) AS support_by_{s}")


def _conf(a: str, b: str) -> str:
    return (f"(SELECT count(*) FROM pend q WHERE q.rna_id=w.rna_id AND q.source<>w.source AND q.e=w.{a} AND q.partner<>w.{b}) AS conflict_{a}")


cte("agr0", f"""SELECT w.*, {_has(0, 0)} AS support, {_src('src_a')}, {_src('src_b')}, {_src('src_c')}, {_conf('i', 'j')}, {_conf('j', 'i')},
   {_has(1, -1)} AS inward_support, {_has(-1, 1)} AS outward_support FROM wpos w""")
cte("agrstem", """SELECT rna_id, source, oi, oj, avg(CASE WHEN support>0 THEN 1.0::DOUBLE ELSE 0 END) AS frac,
   greatest(min(support_by_src_a), min(support_by_src_b), min(support_by_src_c)) AS full_support FROM agr0 GROUP BY 1,2,3,4""")
cte("agr", """SELECT a.*, CASE WHEN support>0 THEN 1 ELSE 0 END AS any_support, CASE WHEN support=2 THEN 1 ELSE 0 END AS all_agree,
   support AS agree_i, support AS agree_j, CASE WHEN conflict_i+conflict_j>0 THEN 1 ELSE 0 END AS any_conflict,
   CASE WHEN n>=2 THEN full_support ELSE 0 END AS stem_full_support, CASE WHEN n>=2 THEN frac ELSE 0 END AS stem_fraction
   FROM agr0 a JOIN agrstem s USING (rna_id, source, oi, oj)""")
oracle("f2_agreement_features", "SELECT * FROM agr")
oracle("f3_support_enrichment", """SELECT *, delete_share/base_rate AS enrichment, min(falls) OVER (PARTITION BY stratum) AS monotonic FROM (
   SELECT *, CASE WHEN delete_share <= coalesce(lag(delete_share) OVER (PARTITION BY stratum ORDER BY support), 2) THEN 1 ELSE 0 END AS falls FROM (
   SELECT stratum, support, count(*) AS n, sum(label_delete) AS deletes, avg(label_delete) AS delete_share,
     sum(sum(label_delete)) OVER (PARTITION BY stratum)::DOUBLE/sum(count(*)) OVER (PARTITION BY stratum) AS base_rate
   FROM (SELECT source AS stratum, * FROM evs UNION ALL SELECT 'ALL', * FROM evs) GROUP BY 1,2))""")
oracle("f4_condition_potential", """SELECT stratum AS source, condition, count(*) AS n, sum(label_delete) AS deletes, count(*)-sum(label_delete) AS keeps
   FROM (SELECT agr.*, label_delete, stratum FROM agr JOIN (SELECT rna_id, source, i, j, label_delete FROM ev) e USING (rna_id, source, i, j), (VALUES (0),(1)) k(k),
     LATERAL (SELECT CASE WHEN k=0 THEN agr.source ELSE 'ALL' END AS stratum)),
   (VALUES ('support_other_count_0'),('support_other_count_1'),('support_other_count_2'),('no_exact_support_plus_partner_conflict'),
     ('no_exact_support_plus_singleton'),('exact_support_by_one_other_model'),('exact_support_by_both_other_models')) v(condition)
   WHERE CASE condition WHEN 'support_other_count_0' THEN support=0 WHEN 'support_other_count_1' THEN support=1 WHEN 'support_other_count_2' THEN support=2
     WHEN 'no_exact_support_plus_partner_conflict' THEN support=0 AND any_conflict=1 WHEN 'no_exact_support_plus_singleton' THEN support=0 AND n=1
     WHEN 'exact_support_by_one_other_model' THEN support=1 ELSE support=2 END GROUP BY 1,2""")


def _t(a: str, b: str) -> str:
    return f"substr(sequence, CAST({a} AS INTEGER)+1, 1)||substr(sequence, CAST({b} AS INTEGER)+1, 1)"


cte("topo", f"""SELECT w.rna_id, w.source, w.i, w.j, w.n, pos, len AS sequence_length, substr(sequence, CAST(i AS INTEGER)+1, 1) AS base_i, substr(sequence, CAST(j AS INTEGER)+1, 1) AS base_j,
   {_t('i', 'j')} AS pair_type, j-i AS raw_separation, (j-i)::DOUBLE/(len-1) AS relative_separation,
   CASE WHEN n=1 THEN 1 ELSE 0 END AS singleton_flag, CASE WHEN n=1 THEN 0 ELSE n END AS strict_stem_length,
   CASE WHEN n=1 THEN 0 ELSE pos END AS stem_pair_position, CASE WHEN n=1 THEN 0 ELSE pos::DOUBLE/(n-1) END AS normalized_stem_position,
   CASE WHEN n>1 AND pos=0 THEN 1 ELSE 0 END AS outer_boundary_flag, CASE WHEN n>1 AND pos=n-1 THEN 1 ELSE 0 END AS inner_boundary_flag,
   CASE WHEN pos>0 THEN 1 ELSE 0 END AS outward_neighbor_exists, CASE WHEN pos<n-1 THEN 1 ELSE 0 END AS inward_neighbor_exists,
   CASE WHEN pos>0 THEN {_t('i-1', 'j+1')} ELSE 'NONE' END AS outward_pair_type, CASE WHEN pos<n-1 THEN {_t('i+1', 'j-1')} ELSE 'NONE' END AS inward_pair_type
   FROM wpos w JOIN base USING (rna_id) JOIN seqs USING (rna_id)""")
cte("lab", "SELECT topo.*, fold, \"partition\", label_delete, risk, gt_pair_count, support FROM topo JOIN evs USING (rna_id, source, i, j)")
oracle("f5_topology_features", "SELECT * FROM topo")
_sums = [f"SELECT '{n}' AS feature, sum({n}) AS total FROM lab" for n in NUMERIC]
for _field, _values in CATEGORIES.items():
    _list = ",".join(f"('{v}')" for v in _values)
    _sums.append(f"SELECT '{_field}='||v, count(l.{_field}) FROM (VALUES {_list}) x(v) LEFT JOIN lab l ON l.{_field}=v GROUP BY 1")
    _sums.append(f"SELECT '{_field}=UNKNOWN', count(*) FILTER ({_field} NOT IN ({','.join(repr(v) for v in _values)})) FROM lab")
_sums += ["SELECT 'support_div_2', sum(support/2.0) FROM lab", "SELECT 'pair_probability', sum(CAST(CAST(1-risk AS FLOAT) AS DOUBLE)) FROM lab"]
# float32 columns: relative positions are summed after the cast
_sums = [s.replace("sum(relative_separation)", "sum(CAST(CAST(relative_separation AS FLOAT) AS DOUBLE))")
          .replace("sum(normalized_stem_position)", "sum(CAST(CAST(normalized_stem_position AS FLOAT) AS DOUBLE))") for s in _sums]
oracle("f6_encode_candidate", " UNION ALL ".join(_sums))
oracle("f7_label_balance", """SELECT source, count(*) AS n, count(*)-sum(label_delete) AS keeps, sum(label_delete) AS deletes, avg(label_delete) AS delete_fraction,
   count(DISTINCT rna_id) AS rnas, count(DISTINCT CASE WHEN label_delete=1 THEN rna_id END) AS rnas_with_delete
   FROM (SELECT source, rna_id, label_delete FROM ev UNION ALL SELECT 'ALL', rna_id, label_delete FROM ev) GROUP BY 1""")
_class = "CASE WHEN pair_type IN ('AU','UA','GC','CG') THEN 'watson_crick' WHEN pair_type IN ('GU','UG') THEN 'wobble' ELSE 'other' END"
_place = "CASE WHEN n=1 THEN 'singleton' WHEN pos=0 THEN 'outer_boundary' WHEN pos=n-1 THEN 'inner_boundary' ELSE '{mid}' END"


def dims(**values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value, label_delete, risk FROM lab" for d, v in values.items())


def _yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"


cte("adims", dims(
    structural_unit="CASE WHEN n>1 THEN 'strict_stem' ELSE 'singleton' END",
    stem_length="CASE n WHEN 1 THEN 'not_in_stem' WHEN 2 THEN 'length_2' WHEN 3 THEN 'length_3' ELSE 'length_4_plus' END",
    stem_position=_place.format(mid="interior"), pair_class=_class, pair_type="pair_type"))
cte("hdims", dims(
    singleton=_yes("n=1"), strict_stem=_yes("n>1"), two_pair_stem=_yes("n=2"), outer_boundary=_yes("n>1 AND pos=0"), inner_boundary=_yes("n>1 AND pos=n-1"),
    topology_position=_place.format(mid="stem_interior"), pair_type="pair_type",
    raw_separation_bin="CASE WHEN j-i<10 THEN 'lt10' WHEN j-i<25 THEN '10_24' WHEN j-i<50 THEN '25_49' ELSE 'ge50' END",
    relative_separation_bin="CASE WHEN relative_separation<=0.25 THEN 'q0_0.25' WHEN relative_separation<=0.5 THEN 'q0.25_0.50' WHEN relative_separation<=0.75 THEN 'q0.50_0.75' ELSE 'q0.75_1.00' END",
    stem_length="CASE WHEN n=1 THEN 'singleton' WHEN n<5 THEN CAST(n AS VARCHAR) ELSE '5_plus' END"))
cte("ddims", dims(
    singleton="CASE WHEN n=1 THEN '1' ELSE '0' END", stem_length="CASE WHEN n=1 THEN '0' ELSE CAST(n AS VARCHAR) END",
    boundary="CASE WHEN n>1 AND (pos=0 OR pos=n-1) THEN 'boundary' ELSE 'interior' END", pair_type="pair_type",
    separation="CASE WHEN j-i<10 THEN 'short' WHEN j-i<25 THEN 'medium' ELSE 'long' END"))
oracle("f8_feature_balance", "SELECT dimension, value, count(*) AS n, sum(label_delete) AS deletes, avg(label_delete) AS delete_fraction FROM adims GROUP BY 1,2")
oracle("f9_pair_class", f"SELECT source, {_class} AS pair_class, count(*) AS n, sum(label_delete) AS deletes FROM lab GROUP BY 1,2")
_std = "CASE WHEN singleton_flag=0 THEN ({c}-(SELECT avg({c}) FROM lab WHERE \"partition\"='train'))/(SELECT stddev_pop({c}) FROM lab WHERE \"partition\"='train') ELSE 0 END AS {c}"
oracle("f10_standardize", "SELECT rna_id, source, i, j, " + ", ".join(_std.format(c=c) for c in ("raw_separation", "relative_separation", "strict_stem_length")) + " FROM lab")
oracle("f11_harm_profile", """SELECT *, harmful::DOUBLE/nullif(sum(harmful) OVER (PARTITION BY dimension),0) AS harm_share,
   beneficial::DOUBLE/nullif(sum(beneficial) OVER (PARTITION BY dimension),0) AS benefit_share FROM (
   SELECT dimension, value, count(*) AS deletions, count(*) FILTER (label_delete=0) AS harmful, sum(label_delete) AS beneficial FROM hdims WHERE risk>=0.5 GROUP BY 1,2)""")

_canon = "('AU','UA','GC','CG','GU','UG')"
cte("trig", f"""SELECT rna_id, source, i, j, 'R1' AS rule FROM topo WHERE n=1 UNION ALL SELECT rna_id, source, i, j, 'R2' FROM topo WHERE n=2
   UNION ALL SELECT rna_id, source, i, j, 'R3' FROM topo WHERE n>=3 AND pos=0 AND pair_type NOT IN {_canon} AND inward_pair_type IN {_canon}""")
cte("conds", """SELECT * FROM (VALUES ('ORIGINAL',''),('R1','R1'),('R2','R2'),('R3','R3'),('R1_R2','R1'),('R1_R2','R2'),('R1_R3','R1'),('R1_R3','R3')) v(condition, rule)""")
cte("redit", """SELECT condition, rna_id, source, i, j, string_agg(rule, '+' ORDER BY rule) AS rules FROM trig JOIN conds USING (rule) GROUP BY 1,2,3,4,5""")
cte("refined", """SELECT c.condition, p.* FROM pred p CROSS JOIN (SELECT DISTINCT condition FROM conds) c
   WHERE NOT EXISTS (SELECT 1 FROM redit e WHERE e.condition=c.condition AND e.rna_id=p.rna_id AND e.source=p.source AND e.i=p.i AND e.j=p.j)""")
oracle("x1_rule_triggers", "SELECT * FROM trig")
oracle("x2_rule_refine", "SELECT * FROM refined")
oracle("x2_rule_edits", "SELECT * FROM redit")
cte("rmet", f"""SELECT *, {prf('tp','fp','fn')} FROM (SELECT c.condition, rec.rna_id, rec.source, count(p.i) FILTER (t.i IS NOT NULL) AS tp,
     count(p.i) FILTER (t.i IS NULL) AS fp, any_value(k.k) - count(p.i) FILTER (t.i IS NOT NULL) AS fn
   FROM rec CROSS JOIN (SELECT DISTINCT condition FROM conds) c JOIN (SELECT rna_id, count(*) AS k FROM truth GROUP BY 1) k ON k.rna_id=rec.rna_id
   LEFT JOIN refined p ON p.rna_id=rec.rna_id AND p.source=rec.source AND p.condition=c.condition
   LEFT JOIN truth t ON t.rna_id=p.rna_id AND t.i=p.i AND t.j=p.j GROUP BY 1,2,3)""")
cte("rsum", f"""SELECT *, f1 AS micro_f1 FROM (SELECT *, {prf('sum_tp','sum_fp','sum_fn')} FROM (
   SELECT condition, source, sum(tp) AS sum_tp, sum(fp) AS sum_fp, sum(fn) AS sum_fn, avg(f1) AS macro_f1 FROM rmet GROUP BY 1,2))""")
oracle("x3_rule_outcomes", """SELECT *, CASE WHEN beneficial+harmful>0 THEN beneficial::DOUBLE/(beneficial+harmful) END AS benefit_share,
   CASE WHEN condition='ORIGINAL' THEN 'REFERENCE' WHEN beneficial<=harmful THEN 'NO USEFUL SIGNAL'
     WHEN delta_macro_f1>1e-12 AND delta_micro_f1>1e-12 THEN 'USEFUL SIGNAL' ELSE 'TRADE-OFF' END AS outcome FROM (
   SELECT r.condition, r.source, r.sum_tp, r.sum_fp, r.sum_fn, r.macro_f1, r.micro_f1, r.macro_f1-o.macro_f1 AS delta_macro_f1,
     r.micro_f1-o.micro_f1 AS delta_micro_f1, o.sum_fp-r.sum_fp AS beneficial, o.sum_tp-r.sum_tp AS harmful
   FROM rsum r JOIN rsum o ON o.source=r.source AND o.condition='ORIGINAL')""")

cte("item", """SELECT CAST(l_suppkey AS VARCHAR) AS rna_id, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS label, l_discount*10 AS score FROM lineitem""")


def ranking(source: str, score: str, label: str, group: str) -> str:
    """AP and AUROC per group by the definition: tie blocks, descending."""
    return f"""SELECT {group} AS grp, sum(n) AS n_events, sum(p) AS positives, sum(p)::DOUBLE/sum(n) AS prevalence,
      CASE WHEN sum(p)>0 THEN sum(p*cp::DOUBLE/cn)/sum(p) END AS average_precision,
      CASE WHEN sum(p)>0 AND sum(n-p)>0 THEN sum(p*(neg-(cn-cp)) + 0.5*p*(n-p))/(sum(p)*sum(n-p)::DOUBLE) END AS auroc FROM (
      SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n-p) OVER (PARTITION BY {group}) AS neg FROM (
        SELECT {group}, {score} AS s, count(*) AS n, sum({label}) AS p FROM {source} GROUP BY 1,2)
      WINDOW w AS (PARTITION BY {group} ORDER BY s DESC)) GROUP BY 1"""


def ece(source: str, score: str, label: str, group: str) -> str:
    return f"""SELECT grp, sum(n*abs(m-o))/sum(n) AS ece FROM (SELECT {group} AS grp, least(floor({score}*10),9) AS b, count(*) AS n, avg({score}) AS m,
      avg({label}) AS o FROM {source} GROUP BY 1,2) GROUP BY 1"""


oracle("m1_average_precision", f"SELECT grp AS rna_id, * FROM ({ranking('item', 'score', 'label', 'rna_id')})")
oracle("m2_auroc", f"SELECT grp AS rna_id, * FROM ({ranking('item', 'score', 'label', 'rna_id')})")
oracle("m3_brier", "SELECT rna_id, avg((score-label)*(score-label)) AS brier FROM item GROUP BY 1")
oracle("m4_ece_bins", """SELECT bin_index, coalesce(n,0) AS n, coalesce(n,0)::DOUBLE/(SELECT count(*) FROM ev) AS weight, mean_score, observed,
   abs(mean_score-observed) AS gap, coalesce(n::DOUBLE/(SELECT count(*) FROM ev)*abs(mean_score-observed),0) AS contribution
   FROM range(0,10) r(bin_index) LEFT JOIN (SELECT least(floor(risk*10),9) AS b, count(*) AS n, avg(risk) AS mean_score, avg(label_delete) AS observed
   FROM ev GROUP BY 1) x ON b=bin_index""")
cte("item1", "SELECT *, 1 AS one FROM item")
oracle("m5_reliability_pooled", f"""SELECT r.*, (SELECT avg((score-label)*(score-label)) FROM item) AS brier, e.ece
   FROM ({ranking('item1', 'score', 'label', 'one')}) r JOIN ({ece('item1', 'score', 'label', 'one')}) e USING (grp)""")
_ms = ("prevalence", "average_precision", "auroc", "brier", "ece")
oracle("m5_reliability_by_group", f"""SELECT count(*) AS groups, {', '.join(f'avg({m}) AS {m}, count({m}) AS {m}_defined' for m in _ms)}
   FROM ({ranking('ev', 'risk', 'label_delete', 'rna_id')}) r JOIN ({ece('ev', 'risk', 'label_delete', 'rna_id')}) e USING (grp)
   JOIN (SELECT rna_id AS grp, avg((risk-label_delete)*(risk-label_delete)) AS brier FROM ev GROUP BY 1) b USING (grp)""")
oracle("m6_prevalence_baseline", """SELECT rotation, stratum, n_test, p AS constant_score, q AS average_precision, CASE WHEN q>0 AND q<1 THEN 0.5 END AS auroc,
   brier, abs(p-q) AS ece FROM (SELECT rotation, stratum, count(*) AS n_test, any_value(p) AS p, avg(label_delete) AS q, avg((p-label_delete)*(p-label_delete)) AS brier
   FROM (SELECT r.rotation, e.*, (SELECT 1) AS x FROM range(0,5) r(rotation), (SELECT source AS stratum, fold, label_delete FROM ev UNION ALL SELECT 'ALL', fold, label_delete FROM ev) e
     WHERE e.fold=r.rotation) JOIN
   (SELECT r.rotation, stratum, avg(label_delete) AS p FROM range(0,5) r(rotation), (SELECT source AS stratum, fold, label_delete FROM ev UNION ALL SELECT 'ALL', fold, label_delete FROM ev) e
     WHERE fold<>rotation AND fold<>(rotation+1)%5 GROUP BY 1,2) tr USING (rotation, stratum) GROUP BY 1,2)""")
oracle("m7_bpp_risk", "SELECT rna_id, source, i, j, 1-(1-max(CASE WHEN source='src_a' THEN risk END) OVER (PARTITION BY rna_id, i, j)) AS risk FROM ev")
cte("doc", """SELECT l.doc_id, d.lang AS source, l.toxic AS label_delete, (d.n_chars%1000)/1000.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)""")


def dcls(source: str, cond: str, keys: str) -> str:
    return f"""SELECT *, {prf('tp','fp','fn')} FROM (SELECT {keys}, count(*) FILTER (({cond}) AND label_delete=1) AS tp,
      count(*) FILTER (({cond}) AND label_delete=0) AS fp, count(*) FILTER (NOT ({cond}) AND label_delete=1) AS fn FROM {source} GROUP BY {keys})"""


oracle("m8_delete_classification", dcls("doc", "score>=0.5", "source"))
oracle("m9_delete_classification_by_feature", dcls("ddims", "risk>=0.5", "dimension, value"))

_div = "CASE WHEN ({b})>0 THEN ({a})::DOUBLE/({b}) END"


def util(keys: str, extra: str, source: str, group: str) -> str:
    """Utility ratios of summed counts."""
    def f(tp, fp, fn):
        return f"CASE WHEN ({tp})+({fp})>0 AND ({tp})+({fn})>0 AND ({tp})>0 THEN 2.0*({tp})/(2*({tp})+({fp})+({fn})) END"
    return f"""SELECT *, resulting_f1-original_f1 AS delta_f1 FROM (SELECT *, {_div.format(a='tp0-lost', b='tp0')} AS tp_preservation, {_div.format(a='removed', b='fp0')} AS fp_removal,
      {_div.format(a='removed', b='lost+removed')} AS modification_precision, {_div.format(a='lost+removed', b='tp0+fp0')} AS coverage,
      {_div.format(a='tp0-lost', b='tp0-lost+fp0-removed')} AS resulting_precision, {_div.format(a='tp0-lost', b='tp0+fn0')} AS resulting_recall,
      {f('tp0-lost', 'fp0-removed', 'fn0+lost')} AS resulting_f1, {_div.format(a='tp0', b='tp0+fp0')} AS original_precision,
      {_div.format(a='tp0', b='tp0+fn0')} AS original_recall, {f('tp0', 'fp0', 'fn0')} AS original_f1 FROM (
      SELECT {keys}{extra}, sum(tp0) AS tp0, sum(fp0) AS fp0, sum(fn0) AS fn0, sum(lost) AS lost, sum(removed) AS removed FROM {source} GROUP BY {group}))"""


cte("ctx", """SELECT rna_id, source, count(*) FILTER (label_delete=0) AS tp0, count(*) FILTER (label_delete=1) AS fp0,
   max(gt_pair_count)-count(*) FILTER (label_delete=0) AS fn0, count(*) FILTER (label_delete=0 AND risk>=0.5) AS lost,
   count(*) FILTER (label_delete=1 AND risk>=0.5) AS removed FROM ev GROUP BY 1,2""")
RATIOS = ("tp_preservation fp_removal modification_precision coverage resulting_precision resulting_recall resulting_f1 original_precision "
          "original_recall original_f1 delta_f1").split()
oracle("u1_deletion_utility_event", util("source", ", count(*) AS contexts", "ctx", "source"))
oracle("u1_deletion_utility_balanced", f"SELECT source, count(*) AS rnas, {', '.join(f'avg({m}) AS {m}, count({m}) AS {m}_defined' for m in RATIOS)} FROM ({util('source, rna_id', '', 'ctx', 'source, rna_id')}) GROUP BY 1")


def curve(source: str, score: str) -> str:
    """The curve by brute force: every threshold against every RNA."""
    return f"""SELECT threshold, CASE WHEN round(event_tp_preservation,12)>=0.99 AND round(balanced_tp_preservation,12)>=0.99 THEN 1 ELSE 0 END AS eligible,
      event_tp_preservation, event_fp_removal, event_modification_precision, deleted, balanced_tp_preservation, balanced_fp_removal, balanced_modification_precision FROM (
      SELECT threshold, 1-sum(lost)::DOUBLE/sum(tp) AS event_tp_preservation, sum(removed)::DOUBLE/sum(fp) AS event_fp_removal,
        {_div.format(a='sum(removed)', b='sum(lost)+sum(removed)')} AS event_modification_precision, sum(lost)+sum(removed) AS deleted,
        avg(CASE WHEN tp>0 THEN 1-lost::DOUBLE/tp END) AS balanced_tp_preservation, avg(CASE WHEN fp>0 THEN removed::DOUBLE/fp END) AS balanced_fp_removal,
        avg(CASE WHEN lost+removed>0 THEN removed::DOUBLE/(lost+removed) END) AS balanced_modification_precision FROM (
        SELECT threshold, rna_id, coalesce(sum(n) FILTER (l=0),0) AS tp, coalesce(sum(n) FILTER (l=1),0) AS fp, coalesce(sum(n) FILTER (l=0 AND s>=threshold),0) AS lost,
          coalesce(sum(n) FILTER (l=1 AND s>=threshold),0) AS removed FROM (SELECT rna_id, {score[1]} AS l, {score[0]} AS s, count(*) AS n FROM {source} GROUP BY ALL),
          (SELECT DISTINCT {score[0]} AS threshold FROM {source} UNION ALL SELECT NULL) GROUP BY 1,2) GROUP BY 1)"""


for _r in range(5):
    cte(f"val{_r}", f"SELECT * FROM ev WHERE fold={(_r + 1) % 5}")
    cte(f"ucurve{_r}", curve(f"val{_r}", ("risk", "label_delete")))
oracle("u2_threshold_curve", " UNION ALL ".join(f"SELECT {r} AS rotation, * FROM ucurve{r}" for r in range(5)))
oracle("u2_item_curve", curve("item", ("score", "label")))
oracle("u3_threshold_select", " UNION ALL ".join(f"""SELECT * FROM (SELECT {r} AS rotation, * FROM ucurve{r} WHERE eligible=1 ORDER BY round(balanced_fp_removal,12) DESC,
   coalesce(round(balanced_modification_precision,12), -1) DESC, deleted, coalesce(threshold, 'inf'::DOUBLE) DESC LIMIT 1)""" for r in range(5)))


def grid(source: str, score: str, keys: str, veto: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT *, {prf('tp','fp','fn')}, coalesce({_div.format(a='keep-fp', b='keep')},1) AS tp_preservation, tp+fp AS deleted FROM (
      SELECT {k}threshold, count(*) FILTER (c AND label_delete=1) AS tp, count(*) FILTER (c AND label_delete=0) AS fp,
        count(*) FILTER (NOT c AND label_delete=1) AS fn, count(*) FILTER (label_delete=0) AS keep FROM (
        SELECT *, ({veto}) AND {score}>=threshold AS c FROM {source}, (SELECT k/100.0::DOUBLE AS threshold FROM range(50,100,5) g(k))) GROUP BY ALL)"""


def gsel(points: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT {keys + ', ' if keys else ''}CASE WHEN ok THEN threshold END AS threshold, CASE WHEN ok THEN f1 END AS f1, CASE WHEN ok THEN deleted END AS deleted,
      CASE WHEN ok THEN tp_preservation END AS tp_preservation FROM (SELECT *, row_number() OVER ({part} ORDER BY ok DESC, f1 DESC, threshold DESC, deleted) AS rn FROM (
      SELECT *, tp_preservation>=0.99 AS ok FROM ({points}))) WHERE rn=1"""


oracle("u4_grid_threshold_select", gsel(grid("ev", "risk", ""), ""))
oracle("u4_grid_points", grid("doc", "score", "source"))
cte("gsrc", gsel(grid("ev", "risk", "source"), "source"))
oracle("u5_source_conditional_thresholds", "SELECT *, (SELECT min(CASE WHEN threshold IS NULL THEN 0 ELSE 1 END) FROM gsrc) AS deployable FROM gsrc")
oracle("u6_apply_threshold", "SELECT source, threshold, count(*) AS n, count(*) FILTER (risk>=threshold) AS deleted FROM ev JOIN gsrc USING (source) GROUP BY 1,2")
oracle("u7_consensus_veto", """SELECT source, rule, count(*) FILTER (x) AS deleted, count(*) FILTER (x AND label_delete=0) AS harmful, count(*) FILTER (risk>=0.5 AND NOT x) AS vetoed
   FROM (SELECT *, CASE rule WHEN 'score' THEN risk>=0.5 WHEN 'zero_support' THEN support=0 ELSE risk>=0.5 AND support<2 END AS x
   FROM evs, (VALUES ('score'),('consensus_veto'),('zero_support')) v(rule)) GROUP BY 1,2""")
oracle("u7_recalibrated_veto", gsel(grid("evs", "risk", "", "support<2"), ""))
cte("ctx6", """SELECT rna_id, source, count(*) FILTER (label_delete=0) AS tp, count(*) FILTER (label_delete=1) AS fp,
   max(gt_pair_count)-count(*) FILTER (label_delete=0) AS fn, count(*) FILTER (label_delete=0 AND risk>=0.6) AS lost,
   count(*) FILTER (label_delete=1 AND risk>=0.6) AS removed FROM ev GROUP BY 1,2""")
_f = "2.0*({a})/(2*({a})+({b})+({c}))"
_b, _a = _f.format(a="tp", b="fp", c="fn"), _f.format(a="tp-lost", b="fp-removed", c="fn+lost")
_sb, _sa = _f.format(a="sum(tp)", b="sum(fp)", c="sum(fn)"), _f.format(a="sum(tp)-sum(lost)", b="sum(fp)-sum(removed)", c="sum(fn)+sum(lost)")
oracle("u14_structure_effect", f"""SELECT source, count(*) AS records, avg({_b}) AS macro_before, avg({_a}) AS macro_after, avg({_a})-avg({_b}) AS macro_delta,
   {_sa}-{_sb} AS micro_delta, count(*) FILTER (lost+removed>0) AS modified, sum(lost) AS lost, sum(removed) AS removed,
   sum(removed)::DOUBLE/sum(fp) AS delete_recall, 1-sum(lost)::DOUBLE/sum(tp) AS tp_preservation FROM ctx6 GROUP BY 1""")
cte("cuts3", "SELECT * FROM ev, (VALUES ('low',0.4::DOUBLE),('mid',0.55::DOUBLE),('high',0.7::DOUBLE)) v(condition, cut)")
cte("runs", dcls("cuts3", "risk>=cut", "condition, fold, source"))
oracle("u15_paired_conditions", """SELECT a.condition, count(*) AS pairs, avg(a.f1-b.f1) AS mean_difference, count(*) FILTER (a.f1>b.f1) AS up, count(*) FILTER (a.f1<b.f1) AS down
   FROM runs a JOIN runs b ON a.fold=b.fold AND a.source=b.source AND b.condition='mid' AND a.condition<>'mid' GROUP BY 1""")
_dist = "count(*) AS runs, avg(m) AS mean, stddev_pop(m) AS std, quantile_cont(m,0.5) AS median, min(m) AS min, max(m) AS max"
oracle("u16_run_distribution", f"SELECT condition, {_dist} FROM (SELECT condition, fold, avg(f1) AS m FROM runs GROUP BY 1,2) GROUP BY 1")
oracle("u16_order_distribution", f"""SELECT priority, {_dist} FROM (SELECT o_orderpriority AS priority, o_orderstatus, avg(o_totalprice/100000.0) AS m FROM orders GROUP BY 1,2) GROUP BY 1""")
cte("bev", """SELECT *, CASE WHEN baseline LIKE 'risk%' THEN risk ELSE (2-support)/2.0::DOUBLE END AS bscore, CASE baseline WHEN 'risk_high' THEN risk>=0.7 WHEN 'risk_low' THEN risk>=0.45
   WHEN 'no_support' THEN support=0 ELSE support<2 END AS x, baseline||'/'||rna_id AS brna FROM evs, (VALUES ('risk_high'),('risk_low'),('no_support'),('weak_support')) v(baseline)""")
cte("bctx", """SELECT baseline, source, rna_id, count(*) FILTER (label_delete=0) AS tp0, count(*) FILTER (label_delete=1) AS fp0, max(gt_pair_count)-count(*) FILTER (label_delete=0) AS fn0,
   count(*) FILTER (label_delete=0 AND x) AS lost, count(*) FILTER (label_delete=1 AND x) AS removed FROM bev GROUP BY 1,2,3""")


def _weighted(keys: str) -> str:
    """Event ratios and means over RNAs of their ratios, per key."""
    means = ", ".join(f"avg({m}) AS rna_{m}" for m in ("tp_preservation", "fp_removal", "modification_precision", "delta_f1"))
    return f"""SELECT * FROM (SELECT {keys}, tp_preservation, fp_removal, lost+removed AS deleted FROM ({util(keys, '', 'bctx', keys)}))
      JOIN (SELECT {keys}, {means} FROM ({util(keys + ', rna_id', '', 'bctx', keys + ', rna_id')}) GROUP BY {keys}) USING ({keys})"""


cte("ball", _weighted("baseline"))
cte("bsrc", _weighted("baseline, source"))
cte("bap", f"SELECT split_part(grp,'/',1) AS baseline, avg(average_precision) AS rna_average_precision FROM ({ranking('bev', 'bscore', 'label_delete', 'brna')}) GROUP BY 1")
_enough = "round(tp_preservation,12)>=0.99 AND round(rna_tp_preservation,12)>=0.99"
oracle("u19_strongest_baseline", f"""SELECT b.*, CASE WHEN b.baseline IS NULL THEN 'NO_HIGH_PRESERVATION_ELIGIBLE_BASELINE' ELSE 'SELECTED' END AS status,
   CASE WHEN b.unsafe OR b.signs>1 THEN 'SOURCE_DEPENDENT_COMPARATOR' WHEN b.baseline IS NOT NULL THEN 'NO_SOURCE_SAFETY_FAILURE_AT_0.99' END AS source_dependence
   FROM (SELECT 1) one LEFT JOIN (SELECT a.*, p.rna_average_precision, count(*) OVER () AS eligible_baselines, s.unsafe, s.signs FROM ball a JOIN bap p USING (baseline)
     JOIN (SELECT baseline, bool_or(NOT ({_enough})) AS unsafe, count(DISTINCT rna_delta_f1>0) AS signs FROM bsrc GROUP BY 1) s USING (baseline) WHERE {_enough}
     ORDER BY round(rna_fp_removal,12) DESC, coalesce(round(rna_modification_precision,12),'-inf'::DOUBLE) DESC, coalesce(round(rna_average_precision,12),'-inf'::DOUBLE) DESC, deleted, baseline LIMIT 1) b ON true""")
oracle("u21_edits_by_support", """SELECT *, beneficial::DOUBLE/deletions AS precision, harmful::DOUBLE/nullif(sum(harmful) OVER (PARTITION BY stratum),0) AS harm_share,
   beneficial::DOUBLE/nullif(sum(beneficial) OVER (PARTITION BY stratum),0) AS benefit_share FROM (
   SELECT stratum, support, count(*) AS deletions, sum(label_delete) AS beneficial, count(*)-sum(label_delete) AS harmful
   FROM (SELECT source AS stratum, * FROM evs UNION ALL SELECT 'ALL', * FROM evs) WHERE risk>=0.5 GROUP BY 1,2)""")
cte("mods", "SELECT * FROM evs, (VALUES ('score'),('score_with_veto')) v(model)")
_veto = "(model='score' OR support<2)"
cte("gall", gsel(grid("mods", "risk", "model, fold", _veto), "model, fold"))
cte("gone", gsel(grid("mods", "risk", "model, fold, source", _veto), "model, fold, source"))
oracle("u22_deployability", """SELECT model, scope, count(*) AS runs, sum(ok) AS usable FROM (
   SELECT model, 'GLOBAL' AS scope, (threshold IS NOT NULL)::INT AS ok FROM gall UNION ALL SELECT model, source, (threshold IS NOT NULL)::INT FROM gone
   UNION ALL SELECT model, 'ALL_SOURCES', min((threshold IS NOT NULL)::INT) FROM gone GROUP BY model, fold) GROUP BY 1,2""")
