"""DuckDB twins of the registered queries (the correctness oracle).

Every function returns SQL text over the driver's pre-registered views.
They share CTE builders with the adapters so that the Spark view and the
SQL view are defined once each, side by side.
"""

from __future__ import annotations

from ..functions.numeric import rnd_sql
from ..operators.training import draw_sql
from ..operators.windows import anchored_windows_sql
from ..sources.tables import label_pairs_sql, flow_features_sql, packets_from_events_sql


def fragments_cte(width_us: int, max_flow_len: int, labelled: bool = True, max_flows: int = 0) -> str:
    """CTEs ending in ``frag``: long-form fragment packets, like build_fragments."""
    lab = label_pairs_sql() if labelled else "SELECT NULL::VARCHAR AS src, NULL::VARCHAR AS dst, 0 AS label WHERE false"
    return f"""WITH RECURSIVE
    pk AS ({packets_from_events_sql()}),
    ft AS ({flow_features_sql('pk')}),
    {anchored_windows_sql(width_us, 'ft')},
    acc AS (
        SELECT *,
               CASE WHEN fsrc < fdst OR (fsrc = fdst AND fsport <= fdport) THEN fsrc ELSE fdst END AS k_ip1,
               CASE WHEN fsrc < fdst OR (fsrc = fdst AND fsport <= fdport) THEN fsport ELSE fdport END AS k_p1,
               CASE WHEN fsrc < fdst OR (fsrc = fdst AND fsport <= fdport) THEN fdst ELSE fsrc END AS k_ip2,
               CASE WHEN fsrc < fdst OR (fsrc = fdst AND fsport <= fdport) THEN fdport ELSE fsport END AS k_p2
        FROM win WHERE accepted),
    orient AS (
        SELECT capture_id, k_ip1, k_p1, k_ip2, k_p2, fproto,
               arg_min(fsrc, seq) AS o_src, arg_min(fsport, seq) AS o_sport,
               arg_min(fdst, seq) AS o_dst, arg_min(fdport, seq) AS o_dport, min(seq) AS first_seq
        FROM acc GROUP BY ALL),
    cut AS (SELECT capture_id, max(first_seq) AS cut_seq FROM (
                SELECT capture_id, first_seq,
                       row_number() OVER (PARTITION BY capture_id ORDER BY first_seq) AS rn FROM orient) q
            WHERE rn <= {int(max_flows)} GROUP BY capture_id HAVING count(*) >= {int(max_flows)} AND {int(max_flows)} > 0),
    ranked AS (
        SELECT a.*, o.o_src, o.o_sport, o.o_dst, o.o_dport,
               row_number() OVER (PARTITION BY a.capture_id, a.k_ip1, a.k_p1, a.k_ip2, a.k_p2, a.fproto,
                                  a.window_start_us ORDER BY a.seq) AS pos
        FROM acc a JOIN orient o USING (capture_id, k_ip1, k_p1, k_ip2, k_p2, fproto)
        LEFT JOIN cut c ON c.capture_id = a.capture_id
        WHERE c.cut_seq IS NULL OR a.seq <= c.cut_seq),
    labs AS ({lab}),
    frag AS (
        SELECT r.capture_id, r.o_src AS src, r.o_sport AS sport, r.o_dst AS dst, r.o_dport AS dport,
               r.fproto AS proto, r.window_start_us, r.pos, r.seq,
               CAST(r.ts_us - min(r.ts_us) OVER (PARTITION BY r.capture_id, r.k_ip1, r.k_p1, r.k_ip2, r.k_p2, r.fproto,
                                                 r.window_start_us) AS DOUBLE) / 1e6 AS f0,
               r.f1, r.f2, r.f3, r.f4, r.f5, r.f6, r.f7, r.f8, r.f9, r.f10,
               CAST(coalesce(l.label, 0) AS INTEGER) AS label
        FROM ranked r LEFT JOIN labs l ON l.src = r.o_src AND l.dst = r.o_dst
        WHERE r.pos <= {int(max_flow_len)})"""


def flow_counts_sql(width_us: int, max_flow_len: int, max_flows: int = 0) -> str:
    return fragments_cte(width_us, max_flow_len, max_flows=max_flows) + """,
    flows AS (
        SELECT capture_id, src, sport, dst, dport, proto, count(DISTINCT window_start_us) AS fragments,
               max(label) AS label
        FROM frag GROUP BY ALL)
    SELECT CASE WHEN label > 0 THEN 'ddos' ELSE 'benign' END AS traffic_class,
           CAST(count(*) AS BIGINT) AS flows, CAST(sum(fragments) AS BIGINT) AS fragments
    FROM flows GROUP BY 1
    UNION ALL
    SELECT 'total', CAST(count(*) AS BIGINT), CAST(sum(fragments) AS BIGINT) FROM flows"""


def windows_sql(width_us: int) -> str:
    return f"""WITH RECURSIVE pk AS ({packets_from_events_sql()}),
    {anchored_windows_sql(width_us, 'pk')}
    SELECT capture_id, window_start_us, CAST(count(*) AS BIGINT) AS frames,
           CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted_frames,
           min(seq) AS first_seq, max(seq) AS last_seq
    FROM win GROUP BY capture_id, window_start_us"""


def fragments_sql(width_us: int, max_flow_len: int) -> str:
    cols = ", ".join(f"{rnd_sql(f'f{i}', 6)} AS f{i}" for i in range(11))
    return fragments_cte(width_us, max_flow_len) + f"""
    SELECT capture_id, src, sport, dst, dport, proto, window_start_us, CAST(pos AS INTEGER) AS pos, seq,
           {cols}, label FROM frag"""


# ---------------------------------------------------------------- decayed statistics
LAMS_SQL = "(SELECT unnest([5.0, 3.0, 1.0, 0.1, 0.01]::DOUBLE[]) AS lam)"
NOISE = 1e-12


def _decay_sums_sql(base: str, key: str, value: str = "v") -> str:
    """Self-join definition: sums over earlier rows of the key, decayed from
    each row's running max T to the current row's T."""
    dec = "pow(2.0, -l.lam * (a.tmax - b.tmax))"
    return f"""SELECT a.seq, l.lam, any_value(a.v0) AS v0, sum({dec}) AS w, sum((b.{value} - b.v0) * {dec}) AS d1,
                      sum((b.{value} - b.v0) * (b.{value} - b.v0) * {dec}) AS d2
               FROM {base} a JOIN {base} b ON a.{key} = b.{key} AND b.seq <= a.seq, {LAMS_SQL} l
               GROUP BY a.seq, l.lam"""


def _mean_var_sql(prefix: str = "") -> tuple[str, str]:
    m = f"({prefix}d1 / {prefix}w)"
    return f"({prefix}v0 + {m})", f"abs({prefix}d2 / {prefix}w - {m} * {m})"


FIRST = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _pcc_sql(cov: str, vo: str, qo: str, vi: str, qi: str) -> str:
    return f"CASE WHEN {vo} > {NOISE!r} * {qo} AND {vi} > {NOISE!r} * {qi} THEN {cov} / (sqrt({vo}) * sqrt({vi})) ELSE 0.0 END"


def decay_1d_sql(source: str, key_expr: str, value_expr: str, where: str = "true",
                 jitter: bool = False, digits=(4, 3, 1)) -> str:
    """W5/W6 oracle. ``source`` is a full SELECT with seq and t columns."""
    v = "v" if not jitter else "coalesce(greatest(t - tprev, 0.0), 0.0)"
    mean, var = _mean_var_sql()
    return f"""WITH src AS ({source}),
    raw AS (SELECT {key_expr} AS k, seq, t, CAST({value_expr} AS DOUBLE) AS v0 FROM src WHERE {where}),
    tt AS (SELECT *, max(t) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax,
                  max(t) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tprev
           FROM raw),
    vv AS (SELECT k, seq, t, tmax, {'v0' if not jitter else v} AS v FROM tt),
    base AS (SELECT *, first_value(v) OVER (PARTITION BY k ORDER BY seq {FIRST}) AS v0 FROM vv),
    s AS ({_decay_sums_sql('base', 'k')})
    SELECT seq, lam, {rnd_sql('w', digits[0])} AS w, {rnd_sql(mean, digits[1])} AS mean,
           {rnd_sql(var, digits[2])} AS var FROM s"""


def _late_cte(source: str, key_expr: str, value_expr: str, delay: float, where: str) -> str:
    return f"""src AS ({source}),
    raw AS (SELECT {key_expr} AS k, seq, t, CAST({value_expr} AS DOUBLE) AS v FROM src WHERE {where}),
    clock AS (SELECT *, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM raw),
    timed AS (SELECT *, coalesce(t < seen - {delay!r}, false) AS late FROM clock)"""


def expired_sql(source: str, key_expr: str, value_expr: str, ttl: float, delay: float, where: str = "true", digits=(4, 3, 1)) -> str:
    """Streams without late rows, cut where a row comes more than ``ttl``
    after the running maximum; then as ``decay_1d_sql``."""
    mean, var = _mean_var_sql()
    return f"""WITH {_late_cte(source, key_expr, value_expr, delay, where)},
    ordered AS (SELECT k, seq, t, v, coalesce(t > max(t) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                                          + {ttl!r}, false) AS anew FROM timed WHERE NOT late),
    lives AS (SELECT k || '#' || sum(CAST(anew AS INT)) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS kl, seq, t, v FROM ordered),
    base AS (SELECT *, max(t) OVER (PARTITION BY kl ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tmax,
                    first_value(v) OVER (PARTITION BY kl ORDER BY seq {FIRST}) AS v0 FROM lives),
    s AS ({_decay_sums_sql('base', 'kl')})
    SELECT seq, lam, {rnd_sql('w', digits[0])} AS w, {rnd_sql(mean, digits[1])} AS mean,
           {rnd_sql(var, digits[2])} AS var FROM s"""


def late_rows_sql(source: str, key_expr: str, delay: float) -> str:
    return f"""WITH {_late_cte(source, key_expr, '0', delay, 'true')}
    SELECT k, count(*) AS late_rows, min(seq) AS first_seq, max(seq) AS last_seq FROM timed WHERE late GROUP BY k"""


def decay_2d_sql(source: str, src_expr: str, dst_expr: str, value_expr: str, where: str = "true") -> str:
    """W7 oracle: sender/receiver streams, then the pair's residual products."""
    mo, vo = _mean_var_sql("o.")
    mi, vi = _mean_var_sql("i.")
    dec = "pow(2.0, -l.lam * (a.tmax - b.tmax))"
    return f"""WITH src AS ({source}),
    raw AS (SELECT {src_expr} AS s, {dst_expr} AS d, seq, t, CAST({value_expr} AS DOUBLE) AS v FROM src WHERE {where}),
    bo AS (SELECT s AS k, seq, v, first_value(v) OVER (PARTITION BY s ORDER BY seq {FIRST}) AS v0, max(t) OVER (PARTITION BY s ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax FROM raw),
    bi AS (SELECT d AS k, seq, v, first_value(v) OVER (PARTITION BY d ORDER BY seq {FIRST}) AS v0, max(t) OVER (PARTITION BY d ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax FROM raw),
    so AS ({_decay_sums_sql('bo', 'k')}),
    si AS ({_decay_sums_sql('bi', 'k')}),
    st AS (SELECT o.seq, o.lam, {mo} AS mean_o, {vo} AS var_o, o.d2 / o.w AS q_o, {mi} AS mean_i, {vi} AS var_i, i.d2 / i.w AS q_i
           FROM so o JOIN si i USING (seq, lam)),
    pr AS (SELECT r.s || '|' || r.d AS pk, r.seq, st.lam, (r.v - st.mean_o) * (r.v - st.mean_i) AS res,
                  max(r.t) OVER (PARTITION BY r.s, r.d, st.lam ORDER BY r.seq
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax
           FROM raw r JOIN st USING (seq)),
    pc AS (SELECT a.seq, a.lam, sum(pow(2.0, -a.lam * (a.tmax - b.tmax))) AS w3,
                  sum(b.res * pow(2.0, -a.lam * (a.tmax - b.tmax))) AS cf3
           FROM pr a JOIN pr b ON a.pk = b.pk AND a.lam = b.lam AND b.seq <= a.seq
           GROUP BY a.seq, a.lam),
    fin AS (SELECT st.seq, st.lam, sqrt(var_o + var_i) AS radius, sqrt(mean_o * mean_o + mean_i * mean_i) AS magnitude,
                   cf3 / w3 AS cov, {_pcc_sql('(cf3 / w3)', 'var_o', 'q_o', 'var_i', 'q_i')} AS pcc
            FROM st JOIN pc USING (seq, lam))
    SELECT seq, lam, {rnd_sql('radius', 3)} AS radius, {rnd_sql('magnitude', 3)} AS magnitude,
           {rnd_sql('cov', 1)} AS cov, {rnd_sql('pcc', 3)} AS pcc
    FROM fin"""


# ---------------------------------------------------------------- dataset preparation
FRAG_COLS = "capture_id, src, sport, dst, dport, proto, window_start_us"


def _scaled_cols(mins, maxs) -> str:
    out = []
    for i, (lo, hi) in enumerate(zip(mins, maxs)):
        rng = float(hi) - float(lo)
        out.append(f"(1.0 - (1.0 * ({float(hi)!r} - f{i})) / {rng!r}) AS f{i}")
    return ", ".join(out)


def normalized_cte(width_us: int, n: int, mins, maxs) -> str:
    return fragments_cte(width_us, n) + f""",
    scaled AS (SELECT {FRAG_COLS}, pos, label, {_scaled_cols(mins, maxs)} FROM frag),
    frags AS (SELECT DISTINCT {FRAG_COLS}, label FROM frag),
    grid AS (SELECT f.*, CAST(g.pos AS INTEGER) AS pos FROM frags f, generate_series(1, {int(n)}) g(pos)),
    padded AS (SELECT g.{FRAG_COLS.replace(', ', ', g.')}, g.pos, g.label,
                      {', '.join(f'coalesce(s.f{i}, 0.0) AS f{i}' for i in range(11))}
               FROM grid g LEFT JOIN scaled s USING ({FRAG_COLS}, pos))"""


def normalized_fragments_sql(width_us: int, n: int, mins, maxs) -> str:
    cols = ", ".join(f"{rnd_sql(f'f{i}', 6)} AS f{i}" for i in range(11))
    return normalized_cte(width_us, n, mins, maxs) + f"""
    SELECT {FRAG_COLS}, pos, label, {cols} FROM padded"""


def packet_counts_sql(width_us: int, n: int, mins, maxs) -> str:
    nz = " + ".join(f"f{i}" for i in range(11))
    return normalized_cte(width_us, n, mins, maxs) + f""",
    c AS (SELECT CASE WHEN label > 0 THEN 'ddos' ELSE 'benign' END AS traffic_class,
                 CASE WHEN (0.0 + {nz}) <> 0 THEN 1 ELSE 0 END AS p FROM padded)
    SELECT traffic_class, CAST(sum(p) AS BIGINT) AS packets, CAST(count(*) AS BIGINT) AS rows FROM c GROUP BY 1
    UNION ALL SELECT 'total', CAST(sum(p) AS BIGINT), CAST(count(*) AS BIGINT) FROM c"""


def feature_bounds_sql(width_us: int, n: int, time_window: float) -> str:
    parts = []
    for i in range(11):
        lo = "min(0.0)" if i == 0 else f"min(f{i})"
        hi = f"max({float(time_window)!r})" if i == 0 else f"greatest(max(f{i}), 0.0)"
        parts.append(f"SELECT {i} AS feature, {rnd_sql(lo, 4)} AS min, {rnd_sql(hi, 4)} AS max FROM frag")
    return fragments_cte(width_us, n) + "\n    " + "\n    UNION ALL ".join(parts)


def flow_vectors_sql(width_us: int, n: int) -> str:
    flag_names = [("ack", 4), ("cwr", 7), ("ece", 6), ("fin", 0), ("push", 3), ("res", 9),
                  ("reset", 2), ("syn", 1), ("urg", 5)]
    tcp = ", ".join(f"{rnd_sql(f'CAST(sum((CAST(f7 AS BIGINT) >> {b}) & 1) AS DOUBLE)', 4)} AS v{8 + i}"
                    for i, (_, b) in enumerate(flag_names))
    return fragments_cte(width_us, n) + f"""
    SELECT {FRAG_COLS},
           {rnd_sql('(arg_max(f0, pos) - arg_min(f0, pos)) / count(*)', 4)} AS v0,
           {rnd_sql('avg(f1)', 4)} AS v1,
           {rnd_sql('CAST(sum((CAST(f3 AS BIGINT) >> 14) & 1) AS DOUBLE)', 4)} AS v2,
           {rnd_sql('CAST(sum((CAST(f3 AS BIGINT) >> 13) & 1) AS DOUBLE)', 4)} AS v3,
           {rnd_sql('CAST(sum((CAST(f3 AS BIGINT) >> 15) & 1) AS DOUBLE)', 4)} AS v4,
           {rnd_sql('avg(CAST(f3 AS BIGINT) & 8191)', 4)} AS v5,
           {rnd_sql('avg(f4)', 4)} AS v6, {rnd_sql('avg(f5)', 4)} AS v7, {tcp},
           {rnd_sql('avg(f8)', 4)} AS v17, {rnd_sql('avg(f9)', 4)} AS v18, {rnd_sql('avg(f10)', 4)} AS v19,
           {rnd_sql('CAST(count(*) AS DOUBLE)', 4)} AS v20, max(label) AS label
    FROM frag GROUP BY ALL"""


def _flows_cte() -> str:
    return """flows AS (SELECT capture_id, src, sport, dst, dport, proto,
                      CAST(count(DISTINCT window_start_us) AS BIGINT) AS fragments, max(label) AS label
               FROM frag GROUP BY capture_id, src, sport, dst, dport, proto)"""


def _hk(seed: int) -> str:
    return (f"md5('{seed}|' || capture_id || '|' || src || '|' || CAST(sport AS VARCHAR) || '|' || dst || '|' "
            f"|| CAST(dport AS VARCHAR) || '|' || CAST(proto AS VARCHAR))")


def balanced_cte(width_us: int, n: int) -> str:
    return fragments_cte(width_us, n) + f""",
    {_flows_cte()},
    tot AS (SELECT sum(CASE WHEN label > 0 THEN fragments ELSE 0 END) AS dd,
                   sum(CASE WHEN label > 0 THEN 0 ELSE fragments END) AS bb FROM flows),
    lim AS (SELECT CASE WHEN dd = 0 OR bb = 0 THEN 'Infinity'::DOUBLE
                        ELSE least(CAST(dd AS DOUBLE), CAST(bb AS DOUBLE)) END AS lim FROM tot),
    ordered AS (SELECT *, coalesce(sum(fragments) OVER (PARTITION BY (label > 0) ORDER BY {_hk(1)}
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM flows),
    balanced AS (SELECT capture_id, src, sport, dst, dport, proto, fragments, label
                 FROM ordered, lim WHERE cum < lim.lim)"""


def balanced_flows_sql(width_us: int, n: int) -> str:
    return balanced_cte(width_us, n) + "\n    SELECT * FROM balanced"


def dataset_split_sql(width_us: int, n: int, train_size: float = 0.9) -> str:
    return balanced_cte(width_us, n) + f""",
    t1 AS (SELECT sum(fragments) AS tot FROM balanced),
    s1 AS (SELECT b.*, coalesce(sum(fragments) OVER (ORDER BY {_hk(2)} ROWS BETWEEN UNBOUNDED PRECEDING
                  AND 1 PRECEDING), 0) AS cum FROM balanced b),
    a1 AS (SELECT s1.*, CASE WHEN cum < (t1.tot - t1.tot * {train_size!r}) THEN 'test' ELSE 'train' END AS split
           FROM s1, t1),
    rest AS (SELECT * EXCLUDE (cum, split) FROM a1 WHERE split = 'train'),
    t2 AS (SELECT sum(fragments) AS tot FROM rest),
    s2 AS (SELECT r.*, coalesce(sum(fragments) OVER (ORDER BY {_hk(3)} ROWS BETWEEN UNBOUNDED PRECEDING
                  AND 1 PRECEDING), 0) AS cum FROM rest r),
    a2 AS (SELECT s2.*, CASE WHEN cum < (t2.tot - t2.tot * {train_size!r}) THEN 'val' ELSE 'train' END AS split
           FROM s2, t2)
    SELECT capture_id, src, sport, dst, dport, proto, fragments, label, split FROM a1 WHERE split = 'test'
    UNION ALL SELECT capture_id, src, sport, dst, dport, proto, fragments, label, split FROM a2"""


# ---------------------------------------------------------------- metrics and robustness
def _embed_cte() -> str:
    z = " + ".join(f"x[{i}]" for i in range(1, 9))
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
    pr AS (SELECT 'probe' AS model, 'part-' || CAST(vec_id % 3 AS VARCHAR) AS source,
                  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
                  CASE WHEN 1.0 / (1.0 + exp(-4.0 * ({z}))) > 0.5 THEN 1 ELSE 0 END AS pred FROM e)"""


def detection_report_sql() -> str:
    def r(x, d=6):
        return rnd_sql(x, d)
    return f"""WITH {_embed_cte()},
    c AS (SELECT model, source, sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn,
                 sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
                 sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn,
                 sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
                 count(*) AS samples, avg(CAST(pred AS DOUBLE)) AS ddos_pct FROM pr GROUP BY model, source)
    SELECT model, source, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
           CAST(tp AS BIGINT) AS tp, CAST(samples AS BIGINT) AS samples, {r('ddos_pct')} AS ddos_pct,
           {r('CAST(tp + tn AS DOUBLE) / samples')} AS accuracy,
           {r('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END')} AS f1,
           {r('CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END')} AS tpr,
           {r('CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END')} AS fpr,
           {r('CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END')} AS tnr,
           {r('CASE WHEN fn + tp > 0 THEN CAST(fn AS DOUBLE) / (fn + tp) END')} AS fnr
    FROM c"""


def _versions_cte(attackers: list[str]) -> str:
    att = ", ".join(f"'{a}'" for a in attackers)
    return f"""pk AS ({packets_from_events_sql()}),
    b AS (SELECT seq, t, src_ip, frame_len AS v FROM pk WHERE accepted),
    a AS (SELECT seq, t, src_ip, v FROM b
          UNION ALL SELECT seq + 1000000000, t + {1.0 / 3600.0!r}, src_ip, 60.0 FROM b WHERE src_ip IN ({att})),
    sb AS (SELECT *, abs(v - avg(v) OVER (PARTITION BY src_ip)) / (stddev_pop(v) OVER (PARTITION BY src_ip) + 1.0)
                  AS rmse FROM b),
    sa AS (SELECT *, abs(v - avg(v) OVER (PARTITION BY src_ip)) / (stddev_pop(v) OVER (PARTITION BY src_ip) + 1.0)
                  AS rmse FROM a)"""


def robustness_sql(attackers: list[str], threshold: float) -> str:
    def r(x, d=6):
        return rnd_sql(x, d)
    return f"""WITH {_versions_cte(attackers)},
    xb AS (SELECT max(t) - min(t) AS dur_before, count(*) AS n_before, avg(rmse) AS mean_before,
                  sum(CASE WHEN rmse > {threshold!r} THEN 1 ELSE 0 END) AS det_before FROM sb),
    xa AS (SELECT max(t) - min(t) AS dur_after, count(*) AS n_after, avg(rmse) AS mean_after,
                  sum(CASE WHEN rmse > {threshold!r} THEN 1 ELSE 0 END) AS det_after FROM sa)
    SELECT {r('dur_before')} AS dur_before, {r('dur_after')} AS dur_after,
           {r('(dur_after - dur_before) / dur_before')} AS duration_rate,
           CAST(n_before AS BIGINT) AS n_before, CAST(n_after AS BIGINT) AS n_after,
           {r('CAST(n_after - n_before AS DOUBLE) / n_before')} AS size_rate,
           {r('mean_before')} AS mean_before, {r('mean_after')} AS mean_after,
           {r('(mean_before - mean_after) / mean_before')} AS score_reduction,
           CAST(det_before AS BIGINT) AS det_before, CAST(det_after AS BIGINT) AS det_after,
           {r('CAST(det_before - det_after AS DOUBLE) / det_before')} AS detection_reduction
    FROM xb, xa"""


def score_alignment_sql(attackers: list[str], extend: float = 2.0) -> str:
    return f"""WITH {_versions_cte(attackers)},
    j AS (SELECT sb.seq, sb.rmse AS before, sa.rmse AS after FROM sb JOIN sa USING (seq)),
    m AS (SELECT avg(before) AS mb FROM j)
    SELECT seq, {rnd_sql('before', 6)} AS before,
           {rnd_sql(f'CASE WHEN after > before * {extend!r} OR after > m.mb * {extend!r} THEN 0.0 ELSE after END', 6)} AS after,
           CASE WHEN after > before * {extend!r} OR after > m.mb * {extend!r} THEN 1 ELSE 0 END AS removed
    FROM j, m"""


def reference_distances_sql(key: str = "q.vec_id") -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
    q AS (SELECT * FROM e WHERE label <> 0), r AS (SELECT * FROM e WHERE label = 0)
    SELECT {key}, {rnd_sql('min(list_distance(q.x, r.x))', 6)} AS min_dist,
           {rnd_sql('max(list_distance(q.x, r.x))', 6)} AS max_dist
    FROM q, r GROUP BY q.vec_id"""


def proximity_ratio_sql(shrink: float = 0.5) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
    q AS (SELECT * FROM e WHERE label <> 0), r AS (SELECT * FROM e WHERE label = 0),
    qa AS (SELECT vec_id, list_transform(x, lambda v: v * {shrink!r}) AS x FROM q),
    db AS (SELECT q.vec_id, max(list_distance(q.x, r.x)) AS d FROM q, r GROUP BY q.vec_id),
    da AS (SELECT qa.vec_id, min(list_distance(qa.x, r.x)) AS d FROM qa, r GROUP BY qa.vec_id),
    s AS (SELECT (SELECT sum(d) FROM db) AS org_dis, (SELECT sum(d) FROM da) AS mut_dis)
    SELECT {rnd_sql('org_dis', 6)} AS org_dis, {rnd_sql('mut_dis', 6)} AS mut_dis,
           {rnd_sql('1.0 - mut_dis / org_dis', 6)} AS proximity_ratio FROM s"""


# ---------------------------------------------------------------- 100-value statistics vector
HOST_DIGITS = {"w": 4, "mean": 3, "var": 1, "radius": 3, "magnitude": 3, "cov": 1, "pcc": 3}


def host_stats_sql(key_mode: str = "typed") -> str:
    sep = "" if key_mode == "concat" else "|"

    def cat(*cols):
        return f" || '{sep}' || ".join(cols) if sep else " || ".join(cols)
    keys = {
        "MI": cat("eth_src", "src_ip"), "Cha": cat("src_ip", "dst_ip"), "jit": cat("src_ip", "dst_ip"),
        "Soc": cat("src_ip", "src_proto", "dst_ip", "dst_proto"),
        "HH_o": "src_ip", "HH_i": "dst_ip",
        "HpHp_o": cat("src_ip", "src_proto"), "HpHp_i": cat("dst_ip", "dst_proto"),
    }
    shared = {"MI": ("HT_MI", 0), "Cha": ("HT_MI", 1), "Soc": ("HT_MI", 2)} if key_mode == "concat" else {}
    roles = "\n      UNION ALL ".join(
        f"SELECT '{r}' AS role, '{shared.get(r, (r, 0))[0]}' AS tbl, {k} AS k, seq, seq * 4 + {shared.get(r, (r, 0))[1]} AS ord, t, v FROM base"
        for r, k in keys.items())
    mean, var = _mean_var_sql()
    piv = ",\n           ".join(f"max(CASE WHEN role = '{r}' THEN {c} END) AS {r}_{c}"
                                for r in keys for c in ("w", "mean", "var", "q"))
    pairs = "\n      UNION ALL ".join(
        f"SELECT '{r}' AS role, {keys[r + '_o']} || '->' || {keys[r + '_i']} AS k, b.seq, b.t, w.lam, "
        f"(b.v - w.{r}_o_mean) * (b.v - w.{r}_i_mean) AS r FROM base b JOIN wide w USING (seq)"
        for r in ("HH", "HpHp"))
    cols = []
    layout = [("MI", ("w", "mean", "var")), ("Cha", ("w", "mean", "var")),
              ("HH", ("radius", "magnitude", "cov", "pcc")), ("jit", ("w", "mean", "var")),
              ("Soc", ("w", "mean", "var")), ("HpHp", ("radius", "magnitude", "cov", "pcc"))]
    idx = 0
    for role, parts in layout:
        for li, lam in enumerate([5.0, 3.0, 1.0, 0.1, 0.01]):
            for p in parts:
                expr = f"max(CASE WHEN lam = {lam!r} THEN {role}_{p} END)"
                cols.append(f"{rnd_sql(expr, HOST_DIGITS[p])} AS x{idx}")
                idx += 1
    two_d = []
    for r in ("HH", "HpHp"):
        two_d.append(f"sqrt({r}_o_var + {r}_i_var) AS {r}_radius")
        two_d.append(f"sqrt({r}_o_mean * {r}_o_mean + {r}_i_mean * {r}_i_mean) AS {r}_magnitude")
        two_d.append(f"{r}_cov")
        two_d.append(_pcc_sql(f"{r}_cov", f"{r}_o_var", f"{r}_o_q", f"{r}_i_var", f"{r}_i_q") + f" AS {r}_pcc")
    return f"""WITH pk AS ({packets_from_events_sql()}),
    base AS (SELECT seq, t, frame_len AS v, eth_src, eth_dst, src_ip, dst_ip,
                    CASE WHEN ip_proto IN (6, 17) THEN CAST(src_port AS VARCHAR) WHEN ip_proto = 1 THEN 'icmp' ELSE '' END AS src_proto,
                    CASE WHEN ip_proto IN (6, 17) THEN CAST(dst_port AS VARCHAR) WHEN ip_proto = 1 THEN 'icmp' ELSE '' END AS dst_proto
             FROM pk WHERE accepted),
    roles AS ({roles}),
    tt AS (SELECT *, max(t) OVER (PARTITION BY tbl, k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax,
                  max(t) OVER (PARTITION BY tbl, k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tprev
           FROM roles),
    rw AS (SELECT role, tbl, k, seq, ord, tmax, CASE WHEN role = 'jit' THEN coalesce(greatest(t - tprev, 0.0), 0.0) ELSE v END AS v FROM tt),
    rv AS (SELECT *, first_value(v) OVER (PARTITION BY tbl, k ORDER BY ord {FIRST}) AS v0 FROM rw),
    s1 AS (SELECT a.role, a.seq, l.lam, any_value(a.v0) AS v0, sum(pow(2.0, -l.lam * (a.tmax - b.tmax))) AS w,
                  sum((b.v - b.v0) * pow(2.0, -l.lam * (a.tmax - b.tmax))) AS d1,
                  sum((b.v - b.v0) * (b.v - b.v0) * pow(2.0, -l.lam * (a.tmax - b.tmax))) AS d2
           FROM rv a JOIN rv b ON a.tbl = b.tbl AND a.k = b.k AND b.ord <= a.ord, {LAMS_SQL} l
           GROUP BY a.role, a.seq, l.lam),
    st AS (SELECT role, seq, lam, w, {mean} AS mean, {var} AS var, d2 / w AS q FROM s1),
    wide AS (SELECT seq, lam,
           {piv}
           FROM st GROUP BY seq, lam),
    pr AS ({pairs}),
    pt AS (SELECT *, max(t) OVER (PARTITION BY role, k, lam ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax FROM pr),
    s2 AS (SELECT a.role, a.seq, a.lam, sum(b.r * pow(2.0, -a.lam * (a.tmax - b.tmax))) / sum(pow(2.0, -a.lam * (a.tmax - b.tmax))) AS cov
           FROM pt a JOIN pt b ON a.role = b.role AND a.k = b.k AND a.lam = b.lam AND b.seq <= a.seq
           GROUP BY a.role, a.seq, a.lam),
    cv AS (SELECT seq, lam, max(CASE WHEN role = 'HH' THEN cov END) AS HH_cov,
                  max(CASE WHEN role = 'HpHp' THEN cov END) AS HpHp_cov FROM s2 GROUP BY seq, lam),
    full_ AS (SELECT w.*, {', '.join(two_d)} FROM wide w JOIN cv USING (seq, lam))
    SELECT seq, {', '.join(cols)} FROM full_ GROUP BY seq"""


# ---------------------------------------------------------------- detector: correlation distance
def correlation_distance_sql(dims: int = 64) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    r AS (SELECT x, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM e),
    f AS (SELECT rank, g.j - 1 AS j, x[g.j] AS xj FROM r, generate_series(1, {dims}) g(j)),
    c AS (SELECT rank, j, xj - sum(xj) OVER (PARTITION BY j ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING
                 AND CURRENT ROW) / CAST(rank + 1 AS DOUBLE) AS c FROM f),
    cm AS (SELECT a.j AS i, b.j AS j, sum(a.c * b.c) AS cc FROM c a JOIN c b ON a.rank = b.rank GROUP BY a.j, b.j),
    dg AS (SELECT i, sqrt(cc) AS s FROM cm WHERE i = j),
    dd AS (SELECT cm.i, cm.j, 1.0 - cm.cc / (CASE WHEN a.s * b.s = 0 THEN 1e-100 ELSE a.s * b.s END) AS d
           FROM cm JOIN dg a ON a.i = cm.i JOIN dg b ON b.i = cm.j)
    SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,
           {rnd_sql('CASE WHEN d < 0 THEN 0.0 ELSE d END', 6)} AS d FROM dd"""


# ---------------------------------------------------------------- reduction
def standardized_sql(dims: int = 64) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    f AS (SELECT vec_id, g.j - 1 AS j, x[g.j] AS v FROM e, generate_series(1, {dims}) g(j)),
    s AS (SELECT j, avg(v) AS m, stddev_pop(v) AS sd FROM f GROUP BY j)
    SELECT vec_id, CAST(j AS INTEGER) AS j,
           {rnd_sql('CASE WHEN sd <> 0 THEN (v - m) / sd ELSE 0.0 END', 6)} AS z
    FROM f JOIN s USING (j)"""


# ---------------------------------------------------------------- streaming
def stream_flow_windows_sql(width_us: int, delay_us: int) -> str:
    lab = label_pairs_sql()
    return f"""WITH pk AS ({packets_from_events_sql()}),
    a AS (SELECT *, ts_us - ((ts_us % {width_us}) + {width_us}) % {width_us} AS ws,
                 CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_ip ELSE dst_ip END AS k1,
                 CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_port ELSE dst_port END AS p1,
                 CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_ip ELSE src_ip END AS k2,
                 CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_port ELSE src_port END AS p2
          FROM pk WHERE accepted),
    wm AS (SELECT max(ts_us) - {delay_us} AS wm FROM pk WHERE accepted),
    g AS (SELECT ws AS window_start_us, k1 AS src, p1 AS sport, k2 AS dst, p2 AS dport, ip_proto AS proto,
                 CAST(count(*) AS BIGINT) AS packets, sum(frame_len) AS bytes, min(seq) AS first_seq
          FROM a GROUP BY ALL),
    labs AS ({lab})
    SELECT g.window_start_us, g.src, g.sport, g.dst, g.dport, g.proto, g.packets, {rnd_sql('g.bytes', 4)} AS bytes,
           g.first_seq, CAST(coalesce(l.label, 0) AS INTEGER) AS label
    FROM g JOIN wm ON g.window_start_us + {width_us} <= wm.wm
    LEFT JOIN labs l ON l.src = g.src AND l.dst = g.dst"""


# ---------------------------------------------------------------- CIDR labels
def _ip_int(expr: str) -> str:
    return (f"(CAST(split_part({expr}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({expr}, '.', 2) AS BIGINT) * 65536"
            f" + CAST(split_part({expr}, '.', 3) AS BIGINT) * 256 + CAST(split_part({expr}, '.', 4) AS BIGINT))")


def cidr_labels_sql(ranges: list[tuple[int, int, int, int]]) -> str:
    """ranges: (attacker first host, last host, victim first host, last host) as integers."""
    conds = []
    for alo, ahi, vlo, vhi in ranges:
        conds.append(f"(s BETWEEN {alo} AND {ahi} AND d BETWEEN {vlo} AND {vhi})")
        conds.append(f"(d BETWEEN {alo} AND {ahi} AND s BETWEEN {vlo} AND {vhi})")
    return f"""WITH pk AS ({packets_from_events_sql()}),
    p AS (SELECT DISTINCT src_ip AS src, dst_ip AS dst FROM pk WHERE accepted),
    q AS (SELECT src, dst, {_ip_int('src')} AS s, {_ip_int('dst')} AS d FROM p)
    SELECT src, dst, CASE WHEN {' OR '.join(conds)} THEN 1 ELSE 0 END AS label FROM q"""


# ---------------------------------------------------------------- detector with fixed parameters
_W = "(((i * 7 + h * 3) % 11 - 5) / 10.0)"


def _member_sql(name: str, source: str, low: float, high: float) -> str:
    """CTEs of one fixed autoencoder over ``source`` (id, grp, i, v)."""
    return _rebuild_sql(name, f"SELECT id, grp, i, (v - ({low!r})) / ({high - low!r} + 1e-16) AS x FROM {source}")


def _rebuild_sql(name: str, scaled: str) -> str:
    """The same over values that are scaled already."""
    return f"""{name}x AS ({scaled}),
    {name}h AS (SELECT id, grp, h, 1.0 / (1.0 + exp(-(sum(x * {_W}) + h / 10.0))) AS y
                FROM {name}x, generate_series(0, 5) t(h) GROUP BY id, grp, h),
    {name}o AS (SELECT id, grp, i, 1.0 / (1.0 + exp(-(sum(y * {_W}) - i / 20.0))) AS z
                FROM {name}h, generate_series(0, 7) t(i) GROUP BY id, grp, i),
    {name}e AS (SELECT id, grp, sqrt(avg((x - z) * (x - z))) AS rmse FROM {name}x JOIN {name}o USING (id, grp, i) GROUP BY id, grp)"""


def _fixed_scores_cte() -> str:
    return f"""e AS (SELECT vec_id AS id, g.grp, k.i, CAST(embedding AS DOUBLE[])[CAST(g.grp * 8 + k.i + 1 AS BIGINT)] AS v
               FROM embeddings, generate_series(0, 7) g(grp), generate_series(0, 7) k(i)),
    {_member_sql('m', 'e', -1.0, 1.0)},
    inner_ AS (SELECT id, 0 AS grp, grp AS i, rmse AS v FROM me),
    {_member_sql('w', 'inner_', 0.0, 1.0)}"""


def detector_score_sql() -> str:
    return f"WITH {_fixed_scores_cte()} SELECT id AS vec_id, {rnd_sql('rmse', 9)} AS rmse FROM we"


def detector_step_sql() -> str:
    return f"""WITH {_fixed_scores_cte()},
    d AS (SELECT id, i, x, (z - x) * z * (1 - z) AS dz FROM mx JOIN mo USING (id, grp, i) WHERE grp = 0),
    hid AS (SELECT id, h, y FROM mh WHERE grp = 0),
    dh AS (SELECT id, h, any_value(y) AS y, sum(dz * {_W}) * any_value(y) * (1 - any_value(y)) AS dy FROM d JOIN hid USING (id) GROUP BY id, h),
    g AS (SELECT i * 6 + h AS k, sum(x * dy + dz * y) AS g FROM d JOIN dh USING (id) GROUP BY i, h
          UNION ALL SELECT 48 + h, sum(dy) FROM dh GROUP BY h
          UNION ALL SELECT 54 + i, sum(dz) FROM d GROUP BY i)
    SELECT CAST(k AS INTEGER) AS k, {rnd_sql('g', 5)} AS g FROM g"""


def averaging_round_sql(replicas: int, rate: float) -> str:
    """First Adam step of every replica (its moments cancel to g / (|g| + 1e-8)), then the mean weighted by rows."""
    run = f"OVER (PARTITION BY id % {replicas}, grp, i ORDER BY id ROWS UNBOUNDED PRECEDING)"
    return f"""WITH e AS (SELECT vec_id AS id, g.grp, k.i, CAST(embedding AS DOUBLE[])[CAST(g.grp * 8 + k.i + 1 AS BIGINT)] AS v
               FROM embeddings, generate_series(0, 7) g(grp), generate_series(0, 7) k(i)),
    rng AS (SELECT *, min(v) {run} AS lo, max(v) {run} AS hi FROM e),
    {_rebuild_sql('m', 'SELECT id, grp, i, (v - lo) / (hi - lo + 1e-16) AS x FROM rng')},
    d AS (SELECT id, grp, i, x, (z - x) * z * (1 - z) AS dz FROM mx JOIN mo USING (id, grp, i)),
    dh AS (SELECT id, grp, h, any_value(y) AS y, sum(dz * {_W}) * any_value(y) * (1 - any_value(y)) AS dy FROM d JOIN mh USING (id, grp) GROUP BY id, grp, h),
    g AS (SELECT id % {replicas} AS r, grp, i * 6 + h AS k, {_W} AS p, sum(x * dy + dz * y) AS g FROM d JOIN dh USING (id, grp) GROUP BY ALL
          UNION ALL SELECT id % {replicas}, grp, 48 + h, h / 10.0, sum(dy) FROM dh GROUP BY ALL
          UNION ALL SELECT id % {replicas}, grp, 54 + i, -i / 20.0, sum(dz) FROM d GROUP BY ALL),
    n AS (SELECT vec_id % {replicas} AS r, count(*) AS n FROM embeddings GROUP BY 1),
    av AS (SELECT grp, k, sum((p - {rate} * (g / n) / (abs(g / n) + 1e-8)) * n) / sum(n) AS v FROM g JOIN n USING (r) GROUP BY grp, k
           UNION ALL SELECT grp, 62 + i, min(v) FROM e GROUP BY grp, i UNION ALL SELECT grp, 70 + i, max(v) FROM e GROUP BY grp, i)
    SELECT CAST(grp AS INTEGER) AS grp, CAST(k AS INTEGER) AS k, {rnd_sql('v', 7)} AS v FROM av"""


def score_summary_sql() -> str:
    return f"""WITH {_fixed_scores_cte()}, t AS (SELECT max(rmse) AS thr FROM we WHERE id % 2 = 0)
    SELECT CAST(sum(CASE WHEN rmse > thr THEN 1 ELSE 0 END) AS BIGINT) AS alerts, CAST(count(*) AS BIGINT) AS total,
           {rnd_sql('avg(rmse)', 6)} AS mean, {rnd_sql('max(rmse)', 6)} AS max, {rnd_sql('any_value(thr)', 6)} AS threshold
    FROM we, t"""


# ---------------------------------------------------------------- small operators over vectors and packets
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
_EJ = "f AS (SELECT vec_id, CAST(g.j - 1 AS INTEGER) AS j, x[g.j] AS v FROM e, generate_series(1, 64) g(j))"


def report_label_values_sql() -> str:
    return f"""WITH c AS (SELECT sum(CASE WHEN label <= 0 AND vec_id % 4 <= 0 THEN 1 ELSE 0 END) AS tn,
                  sum(CASE WHEN label <= 0 AND vec_id % 4 > 0 THEN 1 ELSE 0 END) AS fp,
                  sum(CASE WHEN label > 0 AND vec_id % 4 <= 0 THEN 1 ELSE 0 END) AS fn,
                  sum(CASE WHEN label > 0 AND vec_id % 4 > 0 THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM embeddings)
    SELECT 'all' AS model, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
           CAST(n AS BIGINT) AS samples, {rnd_sql('CAST(tp + tn AS DOUBLE) / n', 6)} AS accuracy, {rnd_sql('2.0 * tp / (2 * tp + fp + fn)', 6)} AS f1 FROM c"""


def packet_counts_vectors_sql(width_us: int, n: int) -> str:
    return fragments_cte(width_us, n) + " SELECT label, CAST(count(*) AS BIGINT) AS packets FROM frag GROUP BY label"


def masked_vectors_sql(cols: list[int]) -> str:
    return f"""WITH {_E}, {_EJ} SELECT vec_id, j, {rnd_sql(f"CASE WHEN j IN ({', '.join(map(str, cols))}) THEN 0.0 ELSE v END", 6)} AS v FROM f"""


def minmax_sql() -> str:
    return f"""WITH {_E}, {_EJ}, b AS (SELECT j, min(v) AS lo, max(v) AS hi FROM f WHERE vec_id % 2 = 0 GROUP BY j)
    SELECT vec_id, j, {rnd_sql('(v - lo) / (hi - lo + 1e-16)', 6)} AS v FROM f JOIN b USING (j)"""


def running_minmax_sql() -> str:
    return f"""WITH {_E}, r AS (SELECT x, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM e),
    f AS (SELECT rank, CAST(g.j - 1 AS INTEGER) AS j, x[g.j] AS v FROM r, generate_series(1, 64) g(j)),
    m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM f
          WINDOW w AS (PARTITION BY j ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT rank, j, {rnd_sql('(v - lo) / (hi - lo + 1e-16)', 6)} AS v FROM m"""


def histogram_sql(source: str, key_expr: str, value_expr: str, where: str, bins: int, lo=None, hi=None, grace=None, window: int = 0) -> str:
    """Weights of all bins of a stream after every row, by self-join."""
    bounds = (f"{lo!r} AS lo, {hi!r} AS hi, 1 AS pos FROM raw" if grace is None else
              f"CASE WHEN b.h > b.l THEN 2 * b.l - b.h END AS lo, CASE WHEN b.h > b.l THEN 2 * b.h - b.l END AS hi, pos FROM n JOIN b USING (k)")
    return f"""WITH src AS ({source}),
    raw AS (SELECT {key_expr} AS k, seq, t, CAST({value_expr} AS DOUBLE) AS v FROM src WHERE {where}),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS pos FROM raw),
    b AS (SELECT k, min(v) FILTER (pos < {grace or 2}) AS l, max(v) FILTER (pos < {grace or 2}) AS h FROM n GROUP BY k),
    bounded AS (SELECT k, seq, t, v, {bounds}),
    binned AS (SELECT *, CASE WHEN pos > {grace or 0} THEN CAST(floor((v - lo) / ((hi - lo) / {bins})) AS BIGINT) END AS raw_bin FROM bounded),
    c AS (SELECT *, CASE WHEN raw_bin >= 0 AND raw_bin < {bins} THEN CAST(raw_bin AS INTEGER) END AS bin FROM binned),
    i AS (SELECT *, max(t) OVER (PARTITION BY k, bin ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tb,
                 max(t) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tk FROM c WHERE bin IS NOT NULL),
    w AS (SELECT a.k, a.seq, l.lam, a.bin, b.bin AS bb, sum(pow(2.0, -l.lam * (a.tk - b.tb))) AS w
          FROM i a JOIN i b ON a.k = b.k AND b.seq <= a.seq, {LAMS_SQL} l GROUP BY ALL),
    s AS (SELECT k, seq, lam, bin, ln(max(w) / (sum(w) FILTER (abs(bb - bin) <= {window})
                 / (least(bin + {window}, {bins - 1}) - greatest(bin - {window}, 0) + 1))) AS score FROM w GROUP BY k, seq, lam, bin),
    u AS (SELECT k, seq, lam, bin, score FROM s UNION ALL
          SELECT k, seq, lam, NULL, CASE WHEN raw_bin IS NULL THEN 0.0 ELSE -1.0 END FROM c, {LAMS_SQL} WHERE bin IS NULL)
    SELECT k, seq, lam, CAST(bin AS INTEGER) AS bin, {rnd_sql('score', 5)} AS score FROM u"""


def extrapolated_cov_sql(source: str, where: str) -> str:
    p = [f"o[len(o){'' if i == 0 else f' - {i}'}]" for i in range(3)]
    ts, vs = [f"{x}.t" for x in p], [f"{x}.v" for x in p]

    def through(points):
        return " + ".join(f"{vs[i]}" + "".join(f" * ((t - {ts[j]}) / ({ts[i]} - {ts[j]}))" for j in points if j != i) for i in points)

    mean, _ = _mean_var_sql()
    return f"""WITH src AS ({source}),
    raw AS (SELECT least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip) AS pair, src_ip > dst_ip AS side, seq, t, CAST(frame_len AS DOUBLE) AS v FROM src WHERE {where}),
    streams AS (SELECT *, pair || CAST(side AS VARCHAR) AS ps FROM raw),
    base AS (SELECT *, max(t) OVER (PARTITION BY ps ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tmax,
                    first_value(v) OVER (PARTITION BY ps ORDER BY seq {FIRST}) AS v0 FROM streams),
    s AS ({_decay_sums_sql('base', 'ps')}),
    m AS (SELECT seq, lam, {mean} AS mean FROM s),
    pts AS (SELECT *, list({{'seq': seq, 't': t, 'v': v}}) FILTER (side) OVER pw AS ones, list({{'seq': seq, 't': t, 'v': v}}) FILTER (NOT side) OVER pw AS zeros
            FROM raw WINDOW pw AS (PARTITION BY pair ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    oth AS (SELECT pair, seq, t, v, coalesce(CASE WHEN side THEN zeros ELSE ones END, []) AS o FROM pts),
    x AS (SELECT pair, seq, t, v, CASE WHEN len(o) > 0 THEN {p[0]}.seq END AS oseq,
                 CASE WHEN len(o) = 0 THEN 0.0 WHEN len(o) = 1 THEN {vs[0]}
                      WHEN len(o) = 2 THEN CASE WHEN t - {ts[0]} > 10 * ({ts[0]} - {ts[1]}) OR {ts[0]} = {ts[1]} THEN {vs[0]} ELSE {through([0, 1])} END
                      WHEN t - {ts[0]} > 10 * ({ts[0]} - {ts[2]}) / 2 OR {ts[0]} = {ts[1]} OR {ts[1]} = {ts[2]} OR {ts[0]} = {ts[2]} THEN {vs[0]}
                      ELSE {through([0, 1, 2])} END AS x FROM oth),
    r AS (SELECT x.pair, x.seq, m.lam, (x.v - m.mean) * (x.x - coalesce(om.mean, 0.0)) AS res,
                 max(x.t) OVER (PARTITION BY x.pair, m.lam ORDER BY x.seq ROWS UNBOUNDED PRECEDING) AS tmax
          FROM x JOIN m USING (seq) LEFT JOIN m om ON om.seq = x.oseq AND om.lam = m.lam),
    c AS (SELECT a.pair, a.seq, a.lam, sum(b.res * pow(2.0, -a.lam * (a.tmax - b.tmax))) / sum(pow(2.0, -a.lam * (a.tmax - b.tmax))) AS cov
          FROM r a JOIN r b ON a.pair = b.pair AND a.lam = b.lam AND b.seq <= a.seq GROUP BY ALL)
    SELECT pair, seq, lam, {rnd_sql('cov', 1)} AS cov FROM c"""


def rolling_mean_sql(source: str) -> str:
    return f"""WITH pk AS ({source})
    SELECT src_ip AS k, seq, {rnd_sql('sum(frame_len) OVER (PARTITION BY src_ip ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5.0', 6)} AS rollmean
    FROM pk WHERE accepted"""


def _last_state_cte(source: str) -> str:
    """Last state of every (host, rate): weights decay to the last running time."""
    mean, var = _mean_var_sql()
    return f"""pk AS ({source}), raw AS (SELECT src_ip AS k, seq, t, frame_len AS v FROM pk WHERE accepted),
    base AS (SELECT *, max(t) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tmax,
                    first_value(v) OVER (PARTITION BY k ORDER BY seq {FIRST}) AS v0,
                    max(seq) OVER (PARTITION BY k) AS last_seq, max(t) OVER (PARTITION BY k) AS tl,
                    last_value(t) OVER (PARTITION BY k ORDER BY seq {FIRST}) AS t_last FROM raw),
    s AS (SELECT k, l.lam, any_value(last_seq) AS seq, any_value(t_last) AS t, any_value(v0) AS v0, sum(pow(2.0, -l.lam * (tl - tmax))) AS w,
                 sum((v - v0) * pow(2.0, -l.lam * (tl - tmax))) AS d1, sum((v - v0) * (v - v0) * pow(2.0, -l.lam * (tl - tmax))) AS d2
          FROM base, {LAMS_SQL} l GROUP BY k, l.lam),
    st AS (SELECT k, lam, seq, t, w, {mean} AS mean, {var} AS var FROM s)"""


def evicted_sql(source: str, after: float, weight: float) -> str:
    return f"""WITH {_last_state_cte(source)}, n AS (SELECT max(t) + {after!r} AS now FROM raw)
    SELECT k, lam, seq, {rnd_sql('w', 4)} AS w FROM st, n WHERE w * pow(2.0, -lam * greatest(now - t, 0.0)) > {weight!r}"""


def nd_stats_sql(source: str) -> str:
    return f"""WITH {_last_state_cte(source)}
    SELECT lam, {rnd_sql('sqrt(sum(var))', 3)} AS radius, {rnd_sql('sqrt(sum(mean * mean))', 3)} AS magnitude FROM st GROUP BY lam"""


def vector_shapes_sql() -> str:
    return f"""WITH {_E} SELECT vec_id, {rnd_sql('list_distance(x[1:8], x[57:64])', 6)} AS dist, {rnd_sql('x[64]', 6)} AS last FROM e"""


def balanced_datasets_sql() -> str:
    return """WITH e AS (SELECT vec_id AS sample_id, label % 3 AS dataset_id, vec_id % 2 AS split FROM embeddings),
    n AS (SELECT split, min(c) AS m FROM (SELECT split, dataset_id, count(*) AS c FROM e GROUP BY ALL) GROUP BY split),
    r AS (SELECT *, row_number() OVER (PARTITION BY split, dataset_id ORDER BY sample_id) AS rn FROM e)
    SELECT sample_id, dataset_id, r.split FROM r JOIN n USING (split) WHERE rn <= m"""


def tensor_store_sql() -> str:
    return f"""WITH {_E} SELECT CASE WHEN vec_id % 2 = 0 THEN 'DOS2018' ELSE 'DOS2019' END AS dataset_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS set_y,
           CAST(count(*) AS BIGINT) AS rows, {rnd_sql('sum(x[1])', 6)} AS x0, 10.0::DOUBLE AS time_window, 10 AS max_flow_len, 'IDS201X' AS merged_id
    FROM e WHERE vec_id % 10 <> 0 GROUP BY 1, 2"""


def vector_store_sql() -> str:
    return f"WITH {_E} SELECT vec_id AS seq, CAST(len(x) AS INTEGER) AS dims, {rnd_sql('list_sum(x)', 6)} AS total FROM e"


def stream_identity_sql(source: str) -> str:
    proto = lambda p: f"CASE WHEN ip_proto IS NULL THEN 'arp' WHEN ip_proto IN (6, 17) THEN CAST({p} AS VARCHAR) ELSE 'icmp' END"
    return f"""WITH pk AS ({source}), i AS (SELECT seq, 0 AS ip_type, CASE WHEN ip_proto IS NULL THEN '10.9.0.1' ELSE src_ip END AS src_ip,
        CASE WHEN ip_proto IS NULL THEN '10.9.0.2' ELSE dst_ip END AS dst_ip, {proto('src_port')} AS src_proto, {proto('dst_port')} AS dst_proto FROM pk)
    SELECT *, regexp_extract(src_ip, '^(.*)\\.', 1) AS subnet FROM i"""


def outliers_sql(extend: float = 2.0) -> str:
    return f"""WITH {_E}, s AS (SELECT x, abs(x[1]) AS b, abs(x[2]) AS a FROM e), m AS (SELECT avg(b) AS mb FROM s),
    r AS (SELECT x, a, (a > b * {extend!r} OR a > mb * {extend!r}) AS o FROM s, m)
    SELECT CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS removed, {rnd_sql('sum(CASE WHEN o THEN 0.0 ELSE a END)', 6)} AS after,
           {rnd_sql('sum(CASE WHEN o THEN 0.0 ELSE abs(x[3]) END)', 6)} AS x2 FROM r"""


def proximity_ratio_normalised_sql(shrink: float = 0.5) -> str:
    scale = "list_transform(list_zip({x}, b.lo, b.hi), lambda t: (t[1] - t[2]) / (t[3] - t[2] + 1e-16))"
    return f"""WITH {_E}, {_EJ.replace('FROM e,', 'FROM (SELECT * FROM e WHERE label = 0) e,')},
    k AS (SELECT j, min(v) AS lo, max(v) AS hi FROM f GROUP BY j),
    b AS (SELECT list(lo ORDER BY j) AS lo, list(hi ORDER BY j) AS hi FROM k),
    r AS (SELECT {scale.format(x='e.x')} AS x FROM e, b WHERE label = 0),
    q AS (SELECT vec_id, {scale.format(x='e.x')} AS x,
                 {scale.format(x=f'list_transform(e.x, lambda v: v * {shrink!r})')} AS xa FROM e, b WHERE label <> 0),
    d AS (SELECT vec_id, max(list_distance(q.x, r.x)) AS far, min(list_distance(q.xa, r.x)) AS near FROM q, r GROUP BY vec_id),
    s AS (SELECT sum(far) AS org_dis, sum(near) AS mut_dis FROM d)
    SELECT {rnd_sql('org_dis', 6)} AS org_dis, {rnd_sql('mut_dis', 6)} AS mut_dis, {rnd_sql('1.0 - mut_dis / org_dis', 6)} AS proximity_ratio FROM s"""


# ---------------------------------------------------------------- networks with parameters by a formula
def _p(i: str) -> str:
    return f"((({i}) * 7 % 13 - 6) / 20.0::DOUBLE)"


def _keep(cell: str, dropout: float) -> str:
    return f"CASE WHEN {draw_sql('id', cell, 3, 1)} >= {dropout} THEN {1.0 / (1.0 - dropout)!r}::DOUBLE ELSE 0.0 END" if dropout else "1.0::DOUBLE"


def _stepped(grads: str, weights: str, l1: float, l2: float, rate: float) -> str:
    """Parameters after a step: (i, g) sums of gradients; ``weights`` marks the penalised ones."""
    new = f"{_p('i')} - {rate} * (g / (SELECT count(*) FROM e) + CASE WHEN {weights} THEN {l1} * sign({_p('i')}) + 2.0 * {l2} * {_p('i')} ELSE 0.0 END)"
    return f"gr AS ({grads}) SELECT CAST(i AS INTEGER) AS i, {rnd_sql(new, 8)} AS v FROM gr"


def _conv_cte(dropout: float = 0.0) -> str:
    """8 x 8 samples, 4 kernels of 3 rows: outputs, largest per kernel, probability."""
    return f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y FROM embeddings),
    z AS (SELECT id, pos, k, sum(x[CAST(pos * 8 + n + 1 AS BIGINT)] * {_p('k * 24 + n')}) + {_p('96 + k')} AS z
          FROM e, range(6) a(pos), range(4) b(k), range(24) c(n) GROUP BY id, pos, k),
    kept AS (SELECT id, pos, k, z, {_keep('pos * 4 + k', dropout)} AS keep FROM z),
    o AS (SELECT id, pos, k, keep, greatest(z * keep, 0.0) AS o FROM kept),
    best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY o DESC, pos) = 1),
    pr AS (SELECT id, 1.0 / (1.0 + exp(-(sum(o * {_p('100 + k')}) + {_p('104')}))) AS p FROM best GROUP BY id)"""


def conv_predict_sql() -> str:
    return f"{_conv_cte()} SELECT id AS vec_id, {rnd_sql('p', 9)} AS p, CAST(p > 0.5 AS INTEGER) AS pred FROM pr"


def conv_step_sql(dropout: float, l1: float, l2: float, rate: float) -> str:
    return f"""{_conv_cte(dropout)},
    s AS (SELECT id, k, pos, o, p - y AS err, x, CASE WHEN o > 0 THEN (p - y) * {_p('100 + k')} * keep ELSE 0.0 END AS slope
          FROM best JOIN pr USING (id) JOIN e USING (id)),
    """ + _stepped("""SELECT k * 24 + n AS i, sum(slope * x[CAST(pos * 8 + n + 1 AS BIGINT)]) AS g FROM s, range(24) c(n) GROUP BY k, n
        UNION ALL SELECT 96 + k, sum(slope) FROM s GROUP BY k UNION ALL SELECT 100 + k, sum(o * err) FROM s GROUP BY k
        UNION ALL SELECT 104, sum(err) FROM s WHERE k = 0""", "i < 96", l1, l2, rate)


def _dense_cte(dropout: float = 0.0) -> str:
    """64 inputs, rectified layers of 6 and 4 units, one sigmoid unit."""
    return f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y FROM embeddings),
    z0 AS (SELECT id, j, sum(x[CAST(i + 1 AS BIGINT)] * {_p('i * 6 + j')}) + {_p('384 + j')} AS z FROM e, range(64) a(i), range(6) b(j) GROUP BY id, j),
    h0 AS (SELECT id, j, greatest(z, 0.0) * keep AS h, CASE WHEN z > 0 THEN keep ELSE 0.0 END AS slope FROM (SELECT *, {_keep('j', dropout)} AS keep FROM z0) q),
    z1 AS (SELECT id, b.j, sum(h * {_p('390 + h0.j * 4 + b.j')}) + {_p('414 + b.j')} AS z FROM h0, range(4) b(j) GROUP BY id, b.j),
    h1 AS (SELECT id, j, greatest(z, 0.0) * keep AS h, CASE WHEN z > 0 THEN keep ELSE 0.0 END AS slope FROM (SELECT *, {_keep('6 + j', dropout)} AS keep FROM z1) q),
    pr AS (SELECT id, 1.0 / (1.0 + exp(-(sum(h * {_p('418 + j')}) + {_p('422')}))) AS p FROM h1 GROUP BY id)"""


def dense_predict_sql() -> str:
    return f"{_dense_cte()} SELECT id AS vec_id, {rnd_sql('p', 9)} AS p, CAST(p > 0.5 AS INTEGER) AS pred FROM pr"


def dense_step_sql(dropout: float, l1: float, l2: float, rate: float) -> str:
    return f"""{_dense_cte(dropout)},
    er AS (SELECT id, p - y AS err FROM pr JOIN e USING (id)),
    d1 AS (SELECT id, j, h, err, err * {_p('418 + j')} * slope AS d FROM h1 JOIN er USING (id)),
    d0 AS (SELECT h0.id, h0.j, sum(d1.d * {_p('390 + h0.j * 4 + d1.j')}) * any_value(h0.slope) AS d FROM h0 JOIN d1 USING (id) GROUP BY h0.id, h0.j),
    """ + _stepped("""SELECT a.i * 6 + j AS i, sum(x[CAST(a.i + 1 AS BIGINT)] * d) AS g FROM d0 JOIN e USING (id), range(64) a(i) GROUP BY a.i, j
        UNION ALL SELECT 384 + j, sum(d) FROM d0 GROUP BY j
        UNION ALL SELECT 390 + h0.j * 4 + d1.j, sum(h0.h * d1.d) FROM h0 JOIN d1 USING (id) GROUP BY h0.j, d1.j
        UNION ALL SELECT 414 + j, sum(d) FROM d1 GROUP BY j
        UNION ALL SELECT 418 + j, sum(h * err) FROM d1 GROUP BY j
        UNION ALL SELECT 422, sum(err) FROM er""", "i < 384 OR i BETWEEN 390 AND 413 OR i BETWEEN 418 AND 421", l1, l2, rate)


def validation_report_sql() -> str:
    return f"""WITH c AS (SELECT sum(CASE WHEN label > 0 AND vec_id % 4 > 0 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN (label > 0) = (vec_id % 4 > 0) THEN 1 ELSE 0 END) AS hits,
        sum(CASE WHEN (label > 0) <> (vec_id % 4 > 0) THEN 1 ELSE 0 END) AS misses, count(*) AS n FROM embeddings)
    SELECT 'probe' AS model, CAST(n AS BIGINT) AS samples, {rnd_sql('CAST(hits AS DOUBLE) / n', 6)} AS accuracy,
           {rnd_sql('2.0 * tp / (2 * tp + misses)', 6)} AS f1, '{{"batch": 1024, "rate": 0.1}}' AS parameters, 'all' AS source FROM c"""


def pca_residual_sql() -> str:
    return f"""WITH {_E}, {_EJ}, c AS (SELECT a.j AS i, b.j AS j, covar_samp(a.v, b.v) AS c FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2)
    SELECT {rnd_sql('sum(CASE WHEN i = j THEN c ELSE 0 END)', 7)} AS trace, {rnd_sql('sum(c * c)', 9)} AS squares, 0.0::DOUBLE AS ortho, 0.0::DOUBLE AS share FROM c"""
