"""Oracle SQL: evidence sampling and edit accounting."""

from oracles.base import cte, oracle, prf

cte("uni", """SELECT rna_id, 'positive_pair' AS channel, i, j FROM truth
   UNION ALL SELECT rna_id, 'unpaired', p, NULL FROM base, range(0,104) r(p) WHERE p<len AND NOT EXISTS (SELECT 1 FROM tend e WHERE e.rna_id=base.rna_id AND e.e=p)""")
oracle("x4_evidence_universe", "SELECT * FROM uni")
cte("unisz", """SELECT rna_id, channel, (SELECT count(*) FROM uni u WHERE u.rna_id=base.rna_id AND u.channel=c.channel) AS sz
   FROM base, (VALUES ('positive_pair'),('unpaired')) c(channel)""")
cte("man", """SELECT 'evidence_v1__'||rna_id||'__'||channel||'__'||density||'__'||seed AS manifest_id, *,
   CASE WHEN density>0 AND sz>0 AND (sz*density+50)//100=0 THEN 1 ELSE least(sz,(sz*density+50)//100) END AS selected,
   CASE WHEN density>0 AND sz>0 AND (sz*density+50)//100=0 THEN 1 ELSE 0 END AS minimum_one
   FROM unisz, (VALUES (0),(1),(5),(10),(20),(50)) d(density), (VALUES (101),(103),(107),(109),(113)) s(seed)""")
cte("ranked", """SELECT m.manifest_id, m.rna_id, m.channel, m.density, m.seed, m.selected, u.i, u.j, row_number() OVER (PARTITION BY m.manifest_id ORDER BY
   sha256(concat_ws(chr(31),'evidence_v1',m.rna_id,m.channel,CAST(m.density AS VARCHAR),CAST(m.seed AS VARCHAR),CAST(u.i AS VARCHAR),CAST(coalesce(u.j,-1) AS VARCHAR)))) AS rk
   FROM man m JOIN uni u ON u.rna_id=m.rna_id AND u.channel=m.channel""")
cte("items", "SELECT manifest_id, rna_id, channel, density, seed, i, j FROM ranked WHERE rk<=selected")
oracle("x5_sample_evidence", "SELECT * FROM items")
cte("nman", "SELECT * FROM man")
cte("nitems", "SELECT * FROM items")
oracle("x5_item_index", "SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY i)-1 AS item_index FROM nitems")
_h = "sha256(concat_ws(chr(31),{m}.manifest_id,CAST(noise AS VARCHAR),CAST({x} AS VARCHAR),'{w}'))"
cte("noisy", "SELECT * FROM (VALUES (5),(10),(20),(30)) v(noise)")
cte("upick", f"""SELECT *, row_number() OVER (PARTITION BY manifest_id, noise ORDER BY {_h.format(m='nitems', x='i', w='choice')}) AS rk,
   (count(*) OVER (PARTITION BY manifest_id, noise)*noise+50)//100 AS wanted FROM nitems CROSS JOIN noisy WHERE channel='unpaired'""")
cte("usup", f"""SELECT noise, d.manifest_id, e AS p, row_number() OVER (PARTITION BY d.manifest_id, noise ORDER BY {_h.format(m='d', x='e', w='supply')}) AS rk
   FROM (SELECT DISTINCT manifest_id, rna_id FROM nitems WHERE channel='unpaired') d JOIN (SELECT DISTINCT rna_id, e FROM tend) t ON t.rna_id=d.rna_id CROSS JOIN noisy""")
cte("ucor", """SELECT u.noise, u.manifest_id, u.rna_id, u.i AS clean_i, CASE WHEN u.rk<=wanted THEN s.p ELSE u.i END AS i,
   CASE WHEN u.rk>wanted THEN 'CLEAN' WHEN s.p IS NULL THEN 'CORRUPTION_UNAVAILABLE' ELSE 'CORRUPTED' END AS status
   FROM upick u LEFT JOIN usup s ON s.manifest_id=u.manifest_id AND s.noise=u.noise AND s.rk=u.rk AND u.rk<=wanted""")
oracle("x6_corrupt_unpaired", "SELECT * FROM ucor")
oracle("x7_validate_evidence", """SELECT manifest_id, 'selected_count' AS finding FROM nman WHERE channel='unpaired' AND CAST(rna_id AS BIGINT)%5=0
   UNION ALL SELECT DISTINCT manifest_id, 'clean_item_modified' FROM ucor WHERE noise=20 AND CAST(rna_id AS BIGINT)%3=0 AND status='CLEAN'""")
# of a pair manifest with items, noise of 30 % or less always leaves a clean one
oracle("x7_validate_corruption", """SELECT noise, manifest_id, 'selected_count' AS finding FROM nman CROSS JOIN noisy WHERE CAST(rna_id AS BIGINT)%5=0
   UNION ALL SELECT DISTINCT noise, manifest_id, 'clean_item_modified' FROM ucor WHERE CAST(rna_id AS BIGINT)%3=0 AND status='CLEAN'
   UNION ALL SELECT noise, manifest_id, 'clean_item_modified' FROM nman CROSS JOIN noisy WHERE channel='positive_pair' AND selected>0 AND CAST(rna_id AS BIGINT)%3=0""")
oracle("x8_payload_hash", """SELECT m.manifest_id, sha256('{"channel":"'||m.channel||'","density":'||m.density||',"items":['||
   coalesce(string_agg('{"i":'||i.i||',"j":'||coalesce(CAST(i.j AS VARCHAR),'null')||'}', ',' ORDER BY i.i, i.j),'')||'],"manifest_id":"'||m.manifest_id||'","rna_id":"'||m.rna_id||
   '","seed":'||m.seed||',"selected":'||m.selected||',"universe_size":'||m.sz||'}') AS payload_sha256
   FROM nman m LEFT JOIN nitems i ON i.manifest_id=m.manifest_id GROUP BY m.manifest_id, m.channel, m.density, m.rna_id, m.seed, m.selected, m.sz""")
oracle("x9_evidence_index", """SELECT channel, density, seed, count(*) AS rnas, sum(selected) AS items, avg(selected) AS mean_items, min(selected) AS min_items,
   max(selected) AS max_items, sum(minimum_one) AS minimum_one, count(*) FILTER (selected=0) AS zero_items, count(*) FILTER (sz=0) AS zero_universe FROM man GROUP BY 1,2,3""")

# results of the hard conditions, by definition
cte("touch", "SELECT manifest_id, i AS e FROM nitems UNION SELECT manifest_id, j FROM nitems WHERE j IS NOT NULL")
cte("scoped", """SELECT m.manifest_id, m.channel, m.density, p.rna_id, p.source, p.i, p.j,
   CASE WHEN x.i IS NULL AND (a.e IS NOT NULL OR b.e IS NOT NULL) THEN 1 ELSE 0 END AS "local"
   FROM nman m JOIN pred p ON p.rna_id=m.rna_id LEFT JOIN (SELECT * FROM nitems WHERE channel='positive_pair') x ON x.manifest_id=m.manifest_id AND x.i=p.i AND x.j=p.j
   LEFT JOIN touch a ON a.manifest_id=m.manifest_id AND a.e=p.i LEFT JOIN touch b ON b.manifest_id=m.manifest_id AND b.e=p.j""")
cte("res", """SELECT 'PAIR_PROTECT_ONLY' AS condition, manifest_id, rna_id, source, i, j FROM scoped WHERE channel='positive_pair' AND "local"=0
   UNION SELECT 'PAIR_HARD_ENFORCE', manifest_id, rna_id, source, i, j FROM scoped WHERE channel='positive_pair' AND "local"=0
   UNION SELECT 'PAIR_HARD_ENFORCE', manifest_id, rna_id, source, i, j FROM nitems CROSS JOIN src WHERE channel='positive_pair'
   UNION SELECT 'UNPAIRED_HARD_DELETE', manifest_id, rna_id, source, i, j FROM scoped WHERE channel='unpaired' AND "local"=0""")
for _key, _name in (("x10_pair_protect", "PAIR_PROTECT_ONLY"), ("x11_pair_enforce", "PAIR_HARD_ENFORCE"), ("x12_unpaired_delete", "UNPAIRED_HARD_DELETE")):
    oracle(_key, f"SELECT * FROM res WHERE condition='{_name}'")
cte("pcross", "SELECT a.rna_id, a.source, a.i, a.j, b.i AS k, b.j AS l FROM pred a JOIN pred b ON b.rna_id=a.rna_id AND b.source=a.source AND a.i<b.i AND b.i<a.j AND a.j<b.j")
oracle("x13_crossing_pairs", "SELECT * FROM pcross")
oracle("x14_minimum_loop", "SELECT rna_id, source, i+3 AS i, j-3 AS j FROM pred WHERE i+3<j-3 AND j-3-(i+3)-1<3")
_elig = """SELECT m.*, coalesce(c.f,0) AS crossing_flag, coalesce(l.f,0) AS loop_flag, l.s AS min_separation,
   CASE WHEN c.f=1 AND l.f=1 THEN 'MULTIPLE' WHEN c.f=1 THEN 'CROSSING' WHEN l.f=1 THEN 'MINIMUM_LOOP' ELSE 'ELIGIBLE' END AS eligibility
   FROM {m} m LEFT JOIN (SELECT DISTINCT a.manifest_id, 1 AS f FROM {i} a JOIN {i} b ON a.manifest_id=b.manifest_id AND a.i<b.i AND b.i<a.j AND a.j<b.j) c USING (manifest_id)
   LEFT JOIN (SELECT manifest_id, max(CASE WHEN j-i-1<3 THEN 1 ELSE 0 END) AS f, min(j-i) AS s FROM {i} WHERE j IS NOT NULL GROUP BY 1) l USING (manifest_id)"""
cte("nelig", _elig.format(m="nman", i="nitems"))
cte("elig", _elig.format(m="man", i="items"))
oracle("x15_manifest_eligibility", "SELECT * FROM nelig")
oracle("x16_eligibility_coverage", """SELECT level, value, sum(n) AS manifests, sum(ok) AS eligible, count(*) AS rnas, count(*) FILTER (ok>0) AS eligible_rnas,
   count(*) FILTER (ok=0) AS zero_coverage_rnas FROM (SELECT level, value, rna_id, count(*) AS n, count(*) FILTER (eligibility='ELIGIBLE') AS ok FROM (
   SELECT 'pooled' AS level, 'all' AS value, rna_id, eligibility FROM elig UNION ALL SELECT 'channel', channel, rna_id, eligibility FROM elig
   UNION ALL SELECT 'density', CAST(density AS VARCHAR), rna_id, eligibility FROM elig UNION ALL SELECT 'seed', CAST(seed AS VARCHAR), rna_id, eligibility FROM elig)
   GROUP BY 1,2,3) GROUP BY 1,2""")
cte("cfault", """SELECT rec.rna_id, rec.source, CASE WHEN d%4=0 AND EXISTS (SELECT 1 FROM pend p WHERE p.rna_id=rec.rna_id AND p.source=rec.source AND p.e=9) THEN 'UNSATISFIABLE'
   WHEN EXISTS (SELECT 1 FROM pcross c WHERE c.rna_id=rec.rna_id AND c.source=rec.source) THEN 'UNSUPPORTED_CROSSING'
   WHEN EXISTS (SELECT 1 FROM pred p WHERE p.rna_id=rec.rna_id AND p.source=rec.source AND p.j-p.i-1<3) THEN 'UNSUPPORTED_MINIMUM_LOOP' END AS code FROM rec""")
oracle("x17_constraint_conflicts", """SELECT f.rna_id, f.source, CASE WHEN code IS NULL THEN t.text END AS text, code FROM cfault f JOIN (
   SELECT rec.rna_id, rec.source, string_agg(CASE WHEN o.i IS NOT NULL THEN '(' WHEN c.j IS NOT NULL THEN ')' WHEN p=9 AND rec.d%4=0 THEN 'x' ELSE '.' END, '' ORDER BY p) AS text
   FROM rec CROSS JOIN range(0,104) r(p) LEFT JOIN pred o ON o.rna_id=rec.rna_id AND o.source=rec.source AND o.i=p
   LEFT JOIN pred c ON c.rna_id=rec.rna_id AND c.source=rec.source AND c.j=p WHERE p<rec.len GROUP BY 1,2) t USING (rna_id, source)""")
cte("rf", "SELECT rna_id, i, j FROM pred WHERE source='src_b'")
oracle("x18_constraint_satisfaction", """SELECT rna_id, count(*) AS n, 'ILLEGAL_PAIR' AS finding FROM rf JOIN seqs USING (rna_id)
     WHERE substr(sequence,CAST(i AS INTEGER)+1,1)||substr(sequence,CAST(j AS INTEGER)+1,1) NOT IN ('AU','UA','GC','CG','GU','UG') GROUP BY 1
   UNION ALL SELECT rna_id, count(*), 'MISSING_FORCED_PAIR' FROM truth t WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.rna_id=t.rna_id AND rf.i=t.i AND rf.j=t.j) GROUP BY 1
   UNION ALL SELECT DISTINCT rna_id, 1, 'PAIRED_FORCED_UNPAIRED' FROM rf WHERE i=9 OR j=9
   UNION ALL SELECT DISTINCT rna_id, 1, 'CROSSING_OUTPUT' FROM pcross WHERE source='src_b'""")
oracle("x19_local_conflict_risk", 'SELECT * FROM scoped')
oracle("x20_disagreement_risk", "SELECT rna_id, source, i, j, 1-max(CASE WHEN source='src_b' THEN 1 ELSE 0 END) OVER (PARTITION BY rna_id, i, j) AS risk FROM pred")
oracle("x21_evidence_scope", """SELECT channel, density, seed, source, scope, count(*) AS n FROM (SELECT m.channel, m.density, m.seed, p.source,
   CASE WHEN x.i IS NOT NULL THEN 'DIRECT' WHEN t.e IS NOT NULL OR u.e IS NOT NULL THEN 'LOCAL_CONFLICT' ELSE 'NON_EVIDENCED' END AS scope
   FROM man m JOIN pred p ON p.rna_id=m.rna_id LEFT JOIN items x ON x.manifest_id=m.manifest_id AND x.i=p.i AND x.j=p.j
   LEFT JOIN (SELECT manifest_id, i AS e FROM items UNION SELECT manifest_id, j FROM items WHERE j IS NOT NULL) t ON t.manifest_id=m.manifest_id AND t.e=p.i
   LEFT JOIN (SELECT manifest_id, i AS e FROM items UNION SELECT manifest_id, j FROM items WHERE j IS NOT NULL) u ON u.manifest_id=m.manifest_id AND u.e=p.j) GROUP BY 1,2,3,4,5""")
cte("mcond", """SELECT m.*, c.condition FROM nman m JOIN (VALUES ('positive_pair','PAIR_PROTECT_ONLY'),('positive_pair','PAIR_HARD_ENFORCE'),('unpaired','UNPAIRED_HARD_DELETE')) c(ch, condition) ON c.ch=m.channel""")
cte("flags", """SELECT condition, manifest_id, rna_id, source, i, j, max(o) AS o, max(t) AS t, max(r) AS r FROM (
   SELECT condition, manifest_id, p.rna_id, source, i, j, 1 AS o, 0 AS t, 0 AS r FROM mcond JOIN pred p USING (rna_id)
   UNION ALL SELECT condition, manifest_id, p.rna_id, source, i, j, 0, 1, 0 FROM mcond JOIN tsrc p USING (rna_id)
   UNION ALL SELECT condition, manifest_id, rna_id, source, i, j, 0, 0, 1 FROM res) GROUP BY 1,2,3,4,5,6""")
cte("sflags", """SELECT f.*, CASE WHEN x.i IS NOT NULL THEN 'DIRECT' WHEN a.e IS NOT NULL OR b.e IS NOT NULL THEN 'LOCAL_CONFLICT' ELSE 'NON_EVIDENCED' END AS scope
   FROM flags f LEFT JOIN nitems x ON x.manifest_id=f.manifest_id AND x.i=f.i AND x.j=f.j
   LEFT JOIN touch a ON a.manifest_id=f.manifest_id AND a.e=f.i LEFT JOIN touch b ON b.manifest_id=f.manifest_id AND b.e=f.j""")
oracle("x22_scope_partition", "SELECT condition, source, scope, count(*) AS n, sum(t) AS in_truth, sum(o) AS in_original, sum(r) AS in_result FROM sflags GROUP BY 1,2,3")
# published names of the item features, as SQL of a candidate (i, j) and an item: a pair (a, b), or a position a
_pair_features = {
    "abs_i_a_norm": "abs(i-a)/dd", "abs_i_b_norm": "abs(i-b)/dd", "abs_j_a_norm": "abs(j-a)/dd", "abs_j_b_norm": "abs(j-b)/dd",
    "min_endpoint_distance_norm": "least(abs(i-a),abs(i-b),abs(j-a),abs(j-b))/dd", "max_endpoint_distance_norm": "greatest(abs(i-a),abs(i-b),abs(j-a),abs(j-b))/dd",
    "candidate_span_norm": "CASE WHEN a IS NOT NULL THEN (j-i)/dd END", "evidence_span_norm": "(b-a)/dd", "signed_span_difference_norm": "(b-a-j+i)/dd", "midpoint_distance_norm": "abs(i+j-a-b)/(2*dd)",
    "exact_same_pair": "(i=a AND j=b)::INT", "shared_endpoint": "(i=a OR i=b OR j=a OR j=b)::INT", "direct_conflict": "((i=a OR i=b OR j=a OR j=b) AND NOT (i=a AND j=b))::INT",
    "relation_CONTAINING": "(a>=i AND b<=j)::INT", "relation_NESTED": "(NOT (a>=i AND b<=j) AND i>=a AND j<=b)::INT",
    "relation_CROSSING": "((i<a AND a<j AND j<b) OR (a<i AND i<b AND b<j))::INT",
    "relation_DISJOINT": "(NOT (a>=i AND b<=j) AND NOT (i>=a AND j<=b) AND NOT ((i<a AND a<j AND j<b) OR (a<i AND i<b AND b<j)))::INT"}
_unpaired_features = {
    "abs_i_k_norm": "abs(i-a)/dd", "abs_j_k_norm": "abs(j-a)/dd", "min_endpoint_distance_norm": "least(abs(i-a),abs(j-a))/dd",
    "max_endpoint_distance_norm": "greatest(abs(i-a),abs(j-a))/dd", "midpoint_distance_norm": "abs(i+j-2*a)/(2*dd)", "k_equals_i": "(a=i)::INT", "k_equals_j": "(a=j)::INT",
    "k_strictly_inside_pair_interval": "(i<a AND a<j)::INT"}
cte("inc", """SELECT p.*, len, len-1.0::DOUBLE AS dd, x.i AS a, x.j AS b, m.channel, m.manifest_id, m.density FROM man m JOIN pred p ON p.rna_id=m.rna_id
   JOIN base ON base.rna_id=m.rna_id LEFT JOIN items x ON x.manifest_id=m.manifest_id""")
for _key, _channel, _features, _item in (("pair", "positive_pair", _pair_features, "a, b"), ("unpaired", "unpaired", _unpaired_features, "a AS k")):
    cte(f"inc_{_key}", f"SELECT manifest_id, density, rna_id, source, i, j, len, a AS ea, {_item}, {', '.join(f'{x} AS {n}' for n, x in _features.items())} FROM inc WHERE channel='{_channel}'")
    oracle(f"x23_{_key}_item_features", f"SELECT * FROM inc_{_key} WHERE ea IS NOT NULL")
    oracle(f"x23_{_key}_item_totals", f"SELECT density, source, count(*) AS n, {', '.join(f'sum({n}) AS {n}' for n in _features)} FROM inc_{_key} WHERE ea IS NOT NULL GROUP BY 1,2")
    _pools = ", ".join(f"coalesce(avg({n}),0) AS mean_{n}, coalesce(max({n}),0) AS max_{n}" for n in _features)
    _support = "coalesce(max(exact_same_pair),0)" if _key == "pair" else "0"
    _conflict = "coalesce(max(direct_conflict),0)" if _key == "pair" else "coalesce(max(greatest(k_equals_i,k_equals_j)),0)"
    oracle("l2_pair_pooled_features" if _key == "pair" else "l2_evidence_pooled_features", f"""SELECT manifest_id, source, i, j, {_pools}, count(ea) AS item_count,
      count(ea)::DOUBLE/any_value(len) AS item_count_div_sequence_length, {_conflict} AS e1_local_conflict, {_support} AS direct_pair_support FROM inc_{_key} GROUP BY 1,2,3,4""")
_p = """count(*) FILTER (o=1 AND t=1 AND r=1) AS preserved_tp, count(*) FILTER (o=1 AND t=1 AND r=0) AS lost_tp, count(*) FILTER (o=1 AND t=0 AND r=0) AS removed_fp,
   count(*) FILTER (o=1 AND t=0 AND r=1) AS preserved_fp, count(*) FILTER (o=0 AND t=1 AND r=1) AS new_tp, count(*) FILTER (o=0 AND t=0 AND r=1) AS new_fp,
   count(*) FILTER (o=1 AND r=1) AS unchanged, count(*) FILTER (o=1 AND r=0) AS deleted, count(*) FILTER (o=0 AND r=1) AS added,
   count(*) FILTER (o=0 AND t=1) AS fn_before, count(*) FILTER (t=1 AND r=0) AS fn_after"""
cte("dec", f"SELECT condition, manifest_id, rna_id, source, {_p} FROM flags GROUP BY 1,2,3,4")
oracle("x24_edit_decomposition", "SELECT * FROM dec")
oracle("x25_edit_counts", f"""SELECT condition, source, removed_fp AS beneficial_deletions, lost_tp AS harmful_deletions, new_tp AS beneficial_insertions, new_fp AS harmful_insertions,
   removed_fp+new_tp AS beneficial_edits, lost_tp+new_fp AS harmful_edits, deleted+added AS modified FROM (SELECT condition, source, {_p} FROM flags GROUP BY 1,2)""")
cte("xcomp", """SELECT q.channel AS channel, q.source AS source, count(*) AS items, sum(b) AS before, sum(a) AS after, count(*) FILTER (b=0 AND a=1) AS rec FROM (
   SELECT n.channel, src.source, CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE p.rna_id=n.rna_id AND p.source=src.source AND p.i=n.i AND p.j=n.j) THEN 1 ELSE 0 END AS b,
     CASE WHEN EXISTS (SELECT 1 FROM res r WHERE r.condition='PAIR_HARD_ENFORCE' AND r.manifest_id=n.manifest_id AND r.source=src.source AND r.i=n.i AND r.j=n.j) THEN 1 ELSE 0 END AS a
   FROM nitems n CROSS JOIN src WHERE n.channel='positive_pair'
   UNION ALL SELECT n.channel, src.source, CASE WHEN EXISTS (SELECT 1 FROM pend p WHERE p.rna_id=n.rna_id AND p.source=src.source AND p.e=n.i) THEN 0 ELSE 1 END,
     CASE WHEN EXISTS (SELECT 1 FROM (SELECT manifest_id, source, i AS e FROM res WHERE condition='UNPAIRED_HARD_DELETE' UNION ALL SELECT manifest_id, source, j FROM res WHERE condition='UNPAIRED_HARD_DELETE') r
       WHERE r.manifest_id=n.manifest_id AND r.source=src.source AND r.e=n.i) THEN 0 ELSE 1 END
   FROM nitems n CROSS JOIN src WHERE n.channel='unpaired') q GROUP BY 1,2""")
# original pairs that share an end with the evidence without being evidence, and those that the hard condition's result lacks
cte("xconf", """SELECT s.channel AS channel, s.source AS source, count(*) AS cb, count(*) FILTER (NOT EXISTS (SELECT 1 FROM res r WHERE r.condition IN ('PAIR_HARD_ENFORCE','UNPAIRED_HARD_DELETE')
     AND r.manifest_id=s.manifest_id AND r.source=s.source AND r.i=s.i AND r.j=s.j)) AS cr FROM scoped s WHERE "local"=1 GROUP BY 1,2""")
oracle("x26_evidence_compliance", """SELECT channel, source, items, before, after, before::DOUBLE/items AS compliance_before, after::DOUBLE/items AS compliance_after,
   CASE WHEN channel='unpaired' THEN 0 ELSE rec END AS recovered, CASE WHEN channel='unpaired' THEN 0 ELSE rec END AS inserted,
   CASE WHEN channel='unpaired' THEN before ELSE 0 END AS already_unpaired, coalesce(cb,0) AS conflicts_before, coalesce(cr,0) AS conflicts_removed,
   cr::DOUBLE/nullif(cb,0) AS correction_rate FROM xcomp LEFT JOIN xconf USING (channel, source)""")


def f1(tp: str, fp: str, fn: str) -> str:
    return prf(tp, fp, fn).rsplit("recall, ", 1)[1].removesuffix(" AS f1")


_before = f1("preserved_tp+lost_tp", "removed_fp+preserved_fp", "fn_before")
_after = f1("preserved_tp+new_tp", "preserved_fp+new_fp", "fn_after")
_pres = "CASE WHEN preserved_tp+lost_tp>0 THEN preserved_tp::DOUBLE/(preserved_tp+lost_tp) ELSE 1 END AS preservation"
oracle("x27_scope_metrics", f"SELECT *, {_before} AS f1_before, {_after} AS f1_after, {_pres} FROM (SELECT condition, source, scope, {_p} FROM sflags GROUP BY 1,2,3)")
_names = "preserved_tp lost_tp removed_fp preserved_fp new_tp new_fp unchanged deleted added fn_before fn_after".split()
_tot = ", ".join(f"sum({n}) AS {n}" for n in _names)


def summary(keys: str, source: str) -> str:
    return f"""SELECT *, macro_after-macro_before AS macro_delta, {_before} AS f1_before, {_after} AS f1_after, {_after}-{_before} AS micro_delta, {_pres},
      CASE WHEN deleted+added>0 THEN (removed_fp+new_tp)::DOUBLE/(deleted+added) END AS modification_precision FROM (
      SELECT {keys}, count(*) AS n, avg({_before}) AS macro_before, avg({_after}) AS macro_after, {_tot} FROM {source} GROUP BY {keys})"""


cte("decm", "SELECT dec.*, m.density, m.seed FROM dec JOIN nman m USING (manifest_id)")
oracle("x28_gain_attribution", f"""SELECT f.density, f.source, f.micro_delta AS full_delta, l.micro_delta AS local_delta, f.micro_delta-l.micro_delta AS insertion_delta
   FROM ({summary('condition, density, source', 'decm')}) f JOIN ({summary('condition, density, source', 'decm')}) l
   ON f.density=l.density AND f.source=l.source AND f.condition='PAIR_HARD_ENFORCE' AND l.condition='PAIR_PROTECT_ONLY'""")
cte("vok", "SELECT manifest_id, channel, rna_id, source FROM nelig JOIN rec USING (rna_id) WHERE eligibility='ELIGIBLE'")
cte("vn", """SELECT 'baseline' AS view, manifest_id, source, count(*) AS n FROM nman JOIN pred USING (rna_id) GROUP BY ALL
   UNION ALL SELECT 'treatment', manifest_id, source, count(*) FROM res WHERE condition<>'PAIR_PROTECT_ONLY' GROUP BY ALL""")
oracle("x29_matched_views", """SELECT channel, v.view, count(*) AS contexts, sum(coalesce(n,0)) AS "rows", count(*) FILTER (n IS NULL) AS empty, 0 AS unmatched
   FROM vok CROSS JOIN (VALUES ('baseline'),('treatment')) v(view) LEFT JOIN vn USING (view, manifest_id, source) GROUP BY 1,2""")
cte("xman", "SELECT manifest_id, rna_id, channel, density, selected FROM nelig WHERE eligibility='ELIGIBLE'")
cte("xmeth", "SELECT * FROM xman, (VALUES ('B0_ORIGINAL'),('B1_LOCAL_HARD'),('B2_GLOBAL_REFOLD')) v(method)")
cte("xflags", """SELECT method, manifest_id, source, i, j, max(o) AS o, max(t) AS t, max(r) AS r FROM (
   SELECT method, manifest_id, source, i, j, 1 AS o, 0 AS t, CASE WHEN method='B0_ORIGINAL' THEN 1 ELSE 0 END AS r FROM xmeth JOIN pred USING (rna_id)
   UNION ALL SELECT method, manifest_id, source, i, j, 0, 1, 0 FROM xmeth JOIN tsrc USING (rna_id)
   UNION ALL SELECT 'B1_LOCAL_HARD', res.manifest_id, source, i, j, 0, 0, 1 FROM res JOIN xman ON xman.manifest_id=res.manifest_id WHERE condition<>'PAIR_PROTECT_ONLY'
   UNION ALL SELECT 'B2_GLOBAL_REFOLD', manifest_id, src.source, i, j, 0, 0, 1 FROM xman JOIN rf USING (rna_id) CROSS JOIN src) GROUP BY 1,2,3,4,5""")
cte("xdec", f"SELECT method, manifest_id, source, {_p} FROM xflags GROUP BY 1,2,3")
cte("xparts", f"""SELECT x.method, x.rna_id, x.channel, x.density, x.selected AS items, s.source, {', '.join(f'coalesce(d.{n},0) AS {n}' for n in _names)}
   FROM xmeth x CROSS JOIN src s LEFT JOIN xdec d ON d.method=x.method AND d.manifest_id=x.manifest_id AND d.source=s.source""")


def xpool(keys: str) -> str:
    q = lambda a, b: f"CASE WHEN ({b})>0 THEN ({a})::DOUBLE/({b}) END"
    return f"""SELECT *, {prf('preserved_tp+new_tp', 'preserved_fp+new_fp', 'fn_after')}, {f1('preserved_tp+lost_tp', 'preserved_fp+removed_fp', 'fn_before')} AS f0,
      {q('preserved_tp', 'preserved_tp+lost_tp')} AS tp_preservation, {q('removed_fp', 'preserved_fp+removed_fp')} AS fp_removal,
      {q('removed_fp+new_tp', 'removed_fp+new_tp+lost_tp+new_fp')} AS modification_precision, {q('removed_fp', 'items')} AS fp_removed_per_evidence_item
      FROM (SELECT {keys}, count(*) AS n, sum(items) AS items, {_tot} FROM xparts GROUP BY {keys})"""


_ratios = "precision recall f1 tp_preservation fp_removal modification_precision fp_removed_per_evidence_item".split()
_k = "channel, density, source, method"
cte("xmic", f"SELECT {_k}, n, items, f0, {', '.join(_names)}, {', '.join(f'{m} AS micro_{m}' for m in _ratios)} FROM ({xpool(_k)})")
cte("xmac", f"""SELECT {_k}, count(*) AS rnas, avg(f0) AS macro_f0, {', '.join(f'avg({m}) AS macro_{m}, count({m}) AS macro_{m}_defined' for m in _ratios)},
   avg((f1-f0)/nullif(items,0)) AS macro_delta_f1_per_evidence_item, count((f1-f0)/nullif(items,0)) AS macro_delta_f1_per_evidence_item_defined FROM ({xpool(_k + ', rna_id')}) GROUP BY {_k}""")
cte("xcmp", f"SELECT * FROM xmic JOIN xmac USING ({_k})")
oracle("x30_method_compare", """SELECT a.*, a.micro_f1-a.f0 AS micro_delta_f1_vs_b0, a.macro_f1-a.macro_f0 AS macro_delta_f1_vs_b0, a.micro_f1-b.micro_f1 AS micro_delta_f1_vs_b1,
   a.macro_f1-b.macro_f1 AS macro_delta_f1_vs_b1, (a.micro_f1-a.f0)/nullif(a.items,0) AS micro_delta_f1_per_evidence_item
   FROM xcmp a JOIN xcmp b ON b.channel=a.channel AND b.density=a.density AND b.source=a.source AND b.method='B1_LOCAL_HARD'""")
oracle("x31_seed_summary", f"""SELECT condition, density, avg(macro_delta) AS macro_delta_mean, stddev_pop(macro_delta) AS macro_delta_std, min(macro_delta) AS macro_delta_min,
   max(macro_delta) AS macro_delta_max, count(macro_delta) AS macro_delta_n FROM ({summary("condition, density, seed", "decm")}) GROUP BY 1,2""")
oracle("x32_zero_evidence_identity", "SELECT rna_id, source, 2 AS distinct_results FROM rec WHERE false")
