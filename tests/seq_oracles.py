"""Small sequential definitions used as test oracles (written from the
documented semantics, one loop each)."""
from __future__ import annotations

import math


def anchored_starts(ts: list[float], width: float) -> list[float]:
    """Window start for each frame in capture order."""
    out, start = [], None
    for t in ts:
        if start is None or t > start + width:
            start = t
        out.append(start)
    return out


def fragments(packets, width, n):
    """packets: (ts, accepted, fwd 5-tuple). Returns {(flow, start): [indices]}."""
    starts = anchored_starts([p[0] for p in packets], width)
    flows, order = {}, []
    for i, ((ts, ok, fwd), st) in enumerate(zip(packets, starts)):
        if not ok:
            continue
        bwd = (fwd[2], fwd[3], fwd[0], fwd[1], fwd[4])
        key = fwd if fwd in flows else bwd if bwd in flows else None
        if key is None:
            key = fwd
            flows[key] = {}
            order.append(key)
        frag = flows[key].setdefault(st, [])
        if len(frag) < n:
            frag.append(i)
    return {(k, s): v for k in order for s, v in flows[k].items()}


class Decayed:
    def __init__(self, lam, t0):
        self.lam, self.last = lam, t0
        self.cf1 = self.cf2 = 0.0
        self.w = 1e-20

    def insert(self, v, t):
        dt = t - self.last
        if dt > 0:
            f = 2.0 ** (-self.lam * dt)
            self.cf1 *= f
            self.cf2 *= f
            self.w *= f
            self.last = t
        self.cf1 += v
        self.cf2 += v * v
        self.w += 1

    def stats(self, eps=1e-9):
        m = self.cf1 / self.w
        var = abs(self.cf2 / self.w - m * m)
        return self.w, m, (0.0 if var <= eps * m * m else var)


def decayed_1d(rows, lam, jitter=False):
    """rows: (key, t, v) in order -> list of (w, mean, var)."""
    st, out = {}, []
    for k, t, v in rows:
        s = st.get(k)
        if s is None:
            s = st[k] = Decayed(lam, t)
        if jitter:
            v = max(t - s.last, 0.0)
        s.insert(v, t)
        out.append(s.stats())
    return out


def decayed_2d(rows, lam):
    """rows: (src, dst, t, v) -> list of (radius, magnitude, cov, pcc)."""
    so, si, pc, out = {}, {}, {}, []
    for s, d, t, v in rows:
        o = so.setdefault(s, Decayed(lam, t))
        i = si.setdefault(d, Decayed(lam, t))
        o.insert(v, t)
        i.insert(v, t)
        _, mo, vo = o.stats()
        _, mi, vi = i.stats()
        c = pc.setdefault((s, d), [0.0, 1e-20, t])
        dt = t - c[2]
        if dt > 0:
            f = 2.0 ** (-lam * dt)
            c[0] *= f
            c[1] *= f
            c[2] = t
        c[0] += (v - mo) * (v - mi)
        c[1] += 1
        cov = c[0] / c[1]
        ss = math.sqrt(vo) * math.sqrt(vi)
        out.append((math.sqrt(vo + vi), math.sqrt(mo * mo + mi * mi), cov, cov / ss if ss != 0 else 0.0))
    return out
