"""SQL twins of the registered queries (DuckDB dialect, plain ANSI where possible).

Each twin is written the naive way -- full candidate lists joined to every
user of a label, a week table joined to all events, the dense distribution
built on a full key x slot grid -- so that it checks the Spark plans'
shortcuts (fan-out cut, one-pass weeks, sparse KL) rather than repeating them.
Views ``lineitem orders customer nation part`` are the generated tables.
"""

from __future__ import annotations

import datetime as dt

from .catalog import (DIST_FROM, EVAL_DATE, EVENT_WEEKS, EVENTS_FROM, EVENTS_TO, GAP_DATE, GAP_WEEKS, K,
                      KL_SPLIT, N, N_TAGS, OFFSET_WEEKS, RECENT_FROM, ROUND, SCORED, SEED, SHIFT,
                      SHIFTED_WEEKS, TO_DATE, WEEKS, WINDOW_DAYS, WINDOW_LENGTH, WINDOWS)

SIGMA_SQL = "CAST(0.0001 AS DOUBLE)"

BASE = [
    ("hist", """SELECT o.o_custkey AS up_id, l.l_partkey AS video_id,
        CAST(o.o_orderdate AS DATE) AS play_date
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE o.o_custkey IS NOT NULL AND l.l_partkey IS NOT NULL
          AND o.o_orderdate IS NOT NULL"""),
    ("prof", """SELECT c.c_custkey AS id, n.n_name AS reside_city, c.c_mktsegment AS phone_type
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    ("trows", """SELECT video_id, video_second_class FROM (
          SELECT p_partkey AS video_id,
                 concat_ws(',', lower(p_type), p_brand, replace(p_name, ' ', ',')) AS video_second_class
          FROM part) t
        WHERE video_second_class IS NOT NULL AND video_second_class <> '' AND video_id IS NOT NULL"""),
    ("tok", """SELECT video_id, video_second_class,
        unnest(list_distinct(list_filter(string_split(video_second_class, ','),
                                         lambda x: x <> ''))) AS tag
        FROM trows"""),
    ("dict", """SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS tag_idx
        FROM (SELECT DISTINCT tag FROM tok) v"""),
    ("ilong", "SELECT t.video_id, t.tag, d.tag_idx FROM tok t JOIN dict d ON t.tag = d.tag"),
]


def _d(day: dt.date) -> str:
    return f"DATE '{day.isoformat()}'"


def _range(lo, hi, col="play_date") -> str:
    conds = ["TRUE"]
    if lo is not None:
        conds.append(f"{col} >= {_d(lo)}")
    if hi is not None:
        conds.append(f"{col} <= {_d(hi)}")
    return " AND ".join(conds)


class Q:
    """Accumulates named CTEs and renders ``WITH ... SELECT``."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = list(BASE)

    def add(self, name: str, sql: str) -> str:
        self.ctes.append((name, sql))
        return name

    def render(self, final: str) -> str:
        body = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in self.ctes)
        return f"WITH {body}\n{final}"

    # -- building blocks ---------------------------------------------------
    def user_dist(self, name, hist="hist", lo=None, hi=None):
        self.add(f"{name}_pairs", f"""SELECT up_id, video_id, count(*) AS c FROM {hist}
            WHERE {_range(lo, hi)} GROUP BY up_id, video_id""")
        return self._dist(name, "up_id")

    def label_dist(self, name, col, hist="hist", lo=None, hi=None):
        self.add(f"{name}_pairs", f"""SELECT p.{col}, h.video_id, count(*) AS c
            FROM {hist} h JOIN prof p ON h.up_id = p.id
            WHERE {_range(lo, hi, 'h.play_date')} GROUP BY p.{col}, h.video_id""")
        return self._dist(name, col)

    def _dist(self, name, key):
        self.add(f"{name}_cnt", f"""SELECT p.{key}, l.tag_idx, CAST(sum(p.c) AS BIGINT) AS n
            FROM {name}_pairs p JOIN ilong l ON p.video_id = l.video_id
            GROUP BY p.{key}, l.tag_idx""")
        self.add(f"{name}_tot", f"""SELECT *, CAST(sum(n) OVER (PARTITION BY {key}) AS BIGINT) AS total
            FROM {name}_cnt""")
        return self.add(name, f"""SELECT {key}, tag_idx, n, total,
            CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS prob FROM {name}_tot""")

    def sample(self, name, dist, key, k=K, seed=SEED):
        self.add(f"{name}_hi", f"""SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY tag_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM {dist}""")
        self.add(f"{name}_draws", f"""SELECT u.{key},
            ('0x' || substr(md5(concat_ws(':', '{seed}', CAST(u.{key} AS VARCHAR),
                                          CAST(r.j AS VARCHAR))), 1, 8))::UBIGINT AS h
            FROM (SELECT DISTINCT {key} FROM {dist}) u CROSS JOIN range({k}) r(j)""")
        return self.add(name, f"""SELECT DISTINCT s.{key}, s.tag_idx, s.n, s.total, s.prob
            FROM {name}_hi s JOIN {name}_draws w ON s.{key} IS NOT DISTINCT FROM w.{key}
            WHERE CAST(w.h AS HUGEINT) * s.total >= CAST(s.hi - s.n AS HUGEINT) * 4294967296
              AND CAST(w.h AS HUGEINT) * s.total < CAST(s.hi AS HUGEINT) * 4294967296""")

    def top(self, name, dist, key, k=K):
        return self.add(name, f"""SELECT {key}, tag_idx, n, total, prob FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, tag_idx) AS rn
            FROM {dist}) t WHERE rn <= {k}""")

    def pop(self, name, hist="hist", lo=None, hi=None):
        self.add(f"{name}_c", f"""SELECT video_id, count(*) AS cnt FROM {hist}
            WHERE {_range(lo, hi)} GROUP BY video_id""")
        return self.add(name, f"""SELECT video_id, cnt,
            CAST(cnt AS DOUBLE) / CAST((SELECT sum(cnt) FROM {name}_c) AS DOUBLE) AS pop
            FROM {name}_c""")

    def score(self, name, sel, key, pop):
        return self.add(name, f"""SELECT s.{key}, x.video_id,
            CAST(sum(s.n) AS DOUBLE) / CAST(s.total AS DOUBLE) AS prob_sum, x.pop
            FROM {sel} s JOIN (SELECT l.video_id, l.tag_idx, p.pop
                               FROM ilong l JOIN {pop} p ON l.video_id = p.video_id) x
              ON s.tag_idx = x.tag_idx
            GROUP BY s.{key}, x.video_id, s.total, x.pop""")

    def fan_out(self, name, cand, col, users=None):
        restrict = f"JOIN {users} su ON su.up_id = p.id" if users else ""
        return self.add(name, f"""SELECT p.id AS up_id, c.video_id, c.prob_sum, c.pop
            FROM {cand} c JOIN prof p ON p.{col} = c.{col} {restrict}""")

    def rank(self, name, cand, seen: list[str], n=N, lim=None, ties="keep"):
        excl = " ".join(f"""AND NOT EXISTS (SELECT 1 FROM {s} x
                              WHERE x.up_id = c.up_id AND x.video_id = c.video_id)"""
                        for s in seen)
        fn = "rank()" if ties == "keep" else "row_number()"
        extra = ", video_id" if ties == "break" else ""
        lim_join = f"JOIN {lim} lm ON lm.up_id = r.up_id AND r.rnk <= lm.lim" if lim else ""
        self.add(f"{name}_r", f"""SELECT c.*, {fn} OVER (PARTITION BY c.up_id
                ORDER BY c.prob_sum DESC, c.pop DESC{extra}) AS rnk
            FROM {cand} c WHERE TRUE {excl}""")
        return self.add(name, f"""SELECT r.up_id, r.video_id, r.prob_sum, r.pop,
            CAST(r.rnk AS INTEGER) AS rank FROM {name}_r r {lim_join} WHERE r.rnk <= {n}""")

    def user_recs(self, name, hist, lo, hi, seen, mode="sample", ties="keep"):
        dist = self.user_dist(f"{name}_d", hist, lo, hi)
        sel = (self.sample(f"{name}_s", dist, "up_id") if mode == "sample"
               else self.top(f"{name}_s", dist, "up_id"))
        pop = self.pop(f"{name}_p", hist, lo, hi)
        cand = self.score(f"{name}_c", sel, "up_id", pop)
        return self.rank(name, cand, seen, ties=ties)

    def label_recs(self, name, col, hist, lo, hi, seen, mode="sample"):
        dist = self.label_dist(f"{name}_d", col, hist, lo, hi)
        sel = (self.sample(f"{name}_s", dist, col) if mode == "sample"
               else self.top(f"{name}_s", dist, col))
        pop = self.pop(f"{name}_p", hist, lo, hi)
        cand = self.score(f"{name}_c", sel, col, pop)
        users = self.fan_out(f"{name}_u", cand, col)
        return self.rank(name, users, seen)

    def two_window(self, name, hist, to_date, window, label=None):
        lo = to_date - dt.timedelta(days=window)
        if label is None:
            recent = self.user_recs(f"{name}_new", hist, lo, to_date, [hist])
            old_dist = self.user_dist(f"{name}_od", hist, None, to_date)
            people = f"SELECT DISTINCT up_id FROM {old_dist}"
        else:
            recent = self.label_recs(f"{name}_new", label, hist, lo, to_date, [hist])
            people = f"SELECT DISTINCT id AS up_id FROM prof WHERE {label} IS NOT NULL"
        self.add(f"{name}_nr", f"SELECT up_id, count(*) AS n_recent FROM {recent} GROUP BY up_id")
        short = self.add(f"{name}_short", f"""SELECT u.up_id,
            coalesce(r.n_recent, 0) AS n_recent, {N} - coalesce(r.n_recent, 0) AS lim
            FROM ({people}) u LEFT JOIN {name}_nr r ON u.up_id = r.up_id
            WHERE {N} - coalesce(r.n_recent, 0) > 0""")
        if label is None:
            sel = self.sample(f"{name}_os", old_dist, "up_id")
            pop = self.pop(f"{name}_op", hist, None, to_date)
            cand = self.score(f"{name}_oc", sel, "up_id", pop)
            cand = self.add(f"{name}_ocs", f"""SELECT c.* FROM {cand} c
                WHERE c.up_id IN (SELECT up_id FROM {short})""")
        else:
            dist = self.label_dist(f"{name}_od", label, hist, None, to_date)
            sel = self.sample(f"{name}_os", dist, label)
            pop = self.pop(f"{name}_op", hist, None, to_date)
            lc = self.score(f"{name}_oc", sel, label, pop)
            cand = self.fan_out(f"{name}_ocs", lc, label, users=short)
        older = self.rank(f"{name}_old", cand, [hist, recent], lim=short)
        return self.add(name, f"""
            SELECT up_id, video_id, rank, 0 AS source FROM {recent}
            UNION ALL
            SELECT o.up_id, o.video_id, CAST(o.rank + s.n_recent AS INTEGER) AS rank, 1 AS source
            FROM {older} o JOIN {short} s ON o.up_id = s.up_id""")

    def precision(self, name, label, split):
        if split == "code":
            cut, rec_date = EVAL_DATE, EVAL_DATE
            self.add(f"{name}_train", f"SELECT * FROM hist WHERE play_date <= {_d(cut)}")
            self.add(f"{name}_test", f"SELECT * FROM hist WHERE play_date >= {_d(cut)}")
        else:
            cut = EVAL_DATE - dt.timedelta(days=WINDOW_DAYS)
            rec_date = cut
            self.add(f"{name}_train", f"SELECT * FROM hist WHERE play_date <= {_d(cut)}")
            self.add(f"{name}_test", f"""SELECT * FROM hist
                WHERE play_date > {_d(cut)} AND play_date <= {_d(EVAL_DATE)}""")
        recs = self.two_window(f"{name}_recs", f"{name}_train", rec_date, WINDOW_DAYS,
                               None if label == "user" else label)
        return f"""SELECT CAST(count(t.up_id) AS BIGINT) AS hits,
              CAST(coalesce(sum(p.c), 0) AS BIGINT) AS recommended,
              CASE WHEN coalesce(sum(p.c), 0) = 0 THEN NULL
                   ELSE CAST(count(t.up_id) AS DOUBLE) / CAST(sum(p.c) AS DOUBLE) END AS precision
            FROM (SELECT up_id, video_id, count(*) AS c FROM {recs} GROUP BY up_id, video_id) p
            LEFT JOIN (SELECT DISTINCT up_id, video_id FROM {name}_test) t
              ON p.up_id = t.up_id AND p.video_id = t.video_id"""

    def kl(self, name, p_table, q_table, keys: list[str], p_col="prob", q_col="prob"):
        """Dense-formula KL(p || q), visiting the union of supports."""
        on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
        ks = ", ".join(keys)
        self.add(f"{name}_sp", f"SELECT {ks}, count(*) AS sp FROM {p_table} GROUP BY {ks}")
        self.add(f"{name}_sq", f"SELECT {ks}, count(*) AS sq FROM {q_table} GROUP BY {ks}")
        self.add(f"{name}_both", f"""SELECT o.*, n.sq FROM {name}_sp o JOIN {name}_sq n ON {on}""")
        co = ", ".join(f"coalesce(o.{k}, n.{k}) AS {k}" for k in keys)
        self.add(f"{name}_j", f"""SELECT {co}, o.{p_col} AS p, n.{q_col} AS q
            FROM {p_table} o FULL OUTER JOIN {q_table} n ON {on} AND o.tag_idx = n.tag_idx""")
        onb = " AND ".join(f"j.{k} = b.{k}" for k in keys)
        jk = ", ".join(f"j.{k}" for k in keys)
        self.add(f"{name}_t", f"""SELECT {jk},
            CASE WHEN p IS NULL THEN {SIGMA_SQL} ELSE p - ({N_TAGS} - b.sp) * {SIGMA_SQL} / b.sp END AS ps,
            CASE WHEN q IS NULL THEN {SIGMA_SQL} ELSE q - ({N_TAGS} - b.sq) * {SIGMA_SQL} / b.sq END AS qs
            FROM {name}_j j JOIN {name}_both b ON {onb}""")
        return self.add(name, f"""SELECT {ks},
            CASE WHEN bool_and(ps > 0 AND qs > 0)
                 THEN sum(CASE WHEN ps > 0 AND qs > 0 THEN ps * log10(ps / qs) END) END AS kl
            FROM {name}_t GROUP BY {ks}""")


def _summary_cols() -> str:
    return (f"count(*) AS n_users, count(*) FILTER (WHERE kl IS NULL) AS n_undefined, "
            f"round(min(kl), {ROUND}) AS kl_min, round(max(kl), {ROUND}) AS kl_max, "
            f"round(avg(kl), {ROUND}) AS kl_avg, round(var_pop(kl), {ROUND}) AS kl_var")


def _simple(final: str) -> str:
    return Q().render(final)


def _dist_user(lo=DIST_FROM, hi=TO_DATE):
    q = Q()
    q.user_dist("du", "hist", lo, hi)
    return q


def _multi_hot_sql(q: Q) -> str:
    q.add("mh_idx", """SELECT video_id, video_second_class, list(tag_idx) AS idxs
        FROM (SELECT DISTINCT t.video_id, t.video_second_class, d.tag_idx
              FROM tok t JOIN dict d ON t.tag = d.tag) v
        GROUP BY video_id, video_second_class""")
    return q.add("mh", f"""SELECT r.video_id,
        [CAST(CASE WHEN list_contains(m.idxs, i) THEN 1 ELSE 0 END AS TINYINT)
         FOR i IN range({N_TAGS})] AS tags
        FROM trows r JOIN mh_idx m
          ON r.video_id = m.video_id AND r.video_second_class = m.video_second_class""")


def _dense(q: Q, dist: str, key: str) -> str:
    return f"""SELECT u.{key}, list(coalesce(d.prob, 0.0) ORDER BY g.i) AS prob
        FROM (SELECT DISTINCT {key} FROM {dist}) u CROSS JOIN range({N_TAGS}) g(i)
        LEFT JOIN {dist} d ON d.{key} IS NOT DISTINCT FROM u.{key} AND d.tag_idx = g.i
        GROUP BY u.{key}"""


def _drift(q: Q, to_date, weeks, offset=0, days=7, reverse=False, hist="hist", long="ilong") -> str:
    """Week table joined to all events; every week is kept, with or without users."""
    q.add("wk", f"""SELECT CAST(i AS INTEGER) AS week,
        {_d(to_date)} - CAST({days} * (i + {offset}) AS INTEGER) AS wend,
        {_d(to_date)} - CAST({days} * (i + {offset} + 1) AS INTEGER) AS wstart
        FROM range({weeks}) r(i)""")
    q.add("wev", f"""SELECT h.up_id, l.tag_idx, h.play_date FROM {hist} h
        JOIN {long} l ON h.video_id = l.video_id WHERE h.play_date <= {_d(to_date)}""")
    for side, cond in (("wo", "e.play_date <= w.wstart"),
                       ("wn", "e.play_date BETWEEN w.wstart AND w.wend")):
        q.add(f"{side}_c", f"""SELECT w.week, e.up_id, e.tag_idx, count(*) AS n
            FROM wev e JOIN wk w ON {cond} GROUP BY w.week, e.up_id, e.tag_idx""")
        q.add(side, f"""SELECT week, up_id, tag_idx,
            CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY week, up_id) AS DOUBLE) AS prob
            FROM {side}_c""")
    sides = ("wn", "wo") if reverse else ("wo", "wn")
    k = q.kl("wkl", *sides, ["week", "up_id"])
    return q.render(f"""SELECT w.week, w.wstart AS week_start, w.wend AS week_end,
        coalesce(s.n_users, 0) AS n_users, coalesce(s.n_undefined, 0) AS n_undefined,
        s.kl_min, s.kl_max, s.kl_avg, s.kl_var
        FROM wk w LEFT JOIN (SELECT week, {_summary_cols()} FROM {k} GROUP BY week) s
        ON s.week = w.week""")


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    out["profile_clean"] = _simple("SELECT id, reside_city, phone_type FROM prof")
    out["history_clean"] = _simple("SELECT up_id, video_id, play_date FROM hist")
    out["tag_dictionary"] = _simple("SELECT tag, tag_idx FROM dict")
    out["item_tags_long"] = _simple("SELECT video_id, tag, tag_idx FROM ilong")
    q = Q()
    out["item_multi_hot"] = q.render(f"SELECT video_id, tags FROM {_multi_hot_sql(q)}")
    out["tag_index_list"] = _simple("SELECT video_id, tag_idx FROM ilong")
    q = Q()
    out["item_popularity"] = q.render(
        f"SELECT video_id, cnt, pop FROM {q.pop('ip', 'hist', RECENT_FROM, TO_DATE)}")
    q = Q()
    q.add("ev", """SELECT user_id AS up_id, event_type AS video_id, CAST(ts AS DATE) AS play_date
        FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND event_type <> ''
          AND ts IS NOT NULL""")
    out["item_popularity_events"] = q.render(
        f"SELECT video_id, cnt, pop FROM {q.pop('ipe', 'ev', EVENTS_FROM, EVENTS_TO)}")
    for label, col in (("city", "reside_city"), ("phone", "phone_type")):
        q = Q()
        d = q.label_dist("dl", col, "hist", DIST_FROM, TO_DATE)
        out[f"tag_dist_{label}"] = q.render(f"SELECT {col}, tag_idx, n, total, prob FROM {d}")
    q = _dist_user()
    out["tag_dist_user"] = q.render("SELECT up_id, tag_idx, n, total, prob FROM du")
    q = _dist_user()
    out["tag_dist_user_dense"] = q.render(_dense(q, "du", "up_id"))
    q = Q()
    d = q.label_dist("dl", "reside_city", "hist", DIST_FROM, TO_DATE)
    out["tag_dist_city_dense"] = q.render(_dense(q, d, "reside_city"))
    q = _dist_user()
    s = q.sample("su", "du", "up_id")
    out["sampled_tags_user"] = q.render(f"SELECT up_id, tag_idx, n, total, prob FROM {s}")
    q = Q()
    d = q.label_dist("dl", "reside_city", "hist", DIST_FROM, TO_DATE)
    s = q.sample("sc", d, "reside_city")
    out["sampled_tags_city"] = q.render(f"SELECT reside_city, tag_idx, n, total, prob FROM {s}")
    q = Q()
    d = q.label_dist("dl", "reside_city", "hist", DIST_FROM, TO_DATE)
    t = q.top("tc", d, "reside_city")
    out["top_tags_city"] = q.render(f"SELECT reside_city, tag_idx, n, total, prob FROM {t}")
    q = _dist_user()
    t = q.top("tu", "du", "up_id")
    out["top_tags_user"] = q.render(f"SELECT up_id, tag_idx, n, total, prob FROM {t}")
    for name, seen in (("score_items_user", ""), ("unseen_candidates", """WHERE NOT EXISTS (
            SELECT 1 FROM hist x WHERE x.up_id = c.up_id AND x.video_id = c.video_id)""")):
        q = _dist_user(RECENT_FROM, TO_DATE)
        s = q.sample("su", "du", "up_id")
        p = q.pop("pp", "hist", RECENT_FROM, TO_DATE)
        c = q.score("sc", s, "up_id", p)
        out[name] = q.render(f"""SELECT up_id, video_id, prob_sum, pop FROM (
            SELECT c.*, rank() OVER (PARTITION BY up_id ORDER BY prob_sum DESC, pop DESC) AS r
            FROM {c} c {seen}) t WHERE r <= {SCORED}""")

    def recs_user(mode="sample", ties="keep", lo=RECENT_FROM):
        q = Q()
        r = q.user_recs("ru", "hist", lo, TO_DATE, ["hist"], mode, ties)
        return q, r

    q, r = recs_user()
    out["recommend_user"] = q.render(f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    q, r = recs_user(mode="top")
    out["recommend_user_top"] = q.render(f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    q, r = recs_user(ties="break")
    out["recommend_user_break_ties"] = q.render(
        f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    q, r = recs_user(lo=None)
    out["recommend_user_all"] = q.render(f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    for name, col, lo in (("city", "reside_city", RECENT_FROM), ("phone", "phone_type", RECENT_FROM),
                          ("city_all", "reside_city", None)):
        q = Q()
        r = q.label_recs("rl", col, "hist", lo, TO_DATE, ["hist"])
        out[f"recommend_{name}"] = q.render(
            f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    q = Q()
    r = q.label_recs("rl", "reside_city", "hist", RECENT_FROM, TO_DATE, [])
    out["label_expanded"] = q.render(f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    q = Q()
    r = q.label_recs("rl", "reside_city", "hist", RECENT_FROM, TO_DATE, ["hist"], mode="top")
    out["recommend_city_top"] = q.render(f"SELECT up_id, video_id, prob_sum, pop, rank FROM {r}")
    q = Q()
    r = q.two_window("tw", "hist", TO_DATE, WINDOW_DAYS)
    out["recommend_user_two_window"] = q.render(f"SELECT up_id, video_id, rank, source FROM {r}")
    for label, col in (("city", "reside_city"), ("phone", "phone_type")):
        q = Q()
        r = q.two_window("tw", "hist", TO_DATE, WINDOW_DAYS, col)
        out[f"recommend_{label}_two_window"] = q.render(
            f"SELECT up_id, video_id, rank, source FROM {r}")

    parts = []
    for split in ("code", "holdout"):
        if split == "code":
            tr, te = f"play_date <= {_d(EVAL_DATE)}", f"play_date >= {_d(EVAL_DATE)}"
        else:
            cut = EVAL_DATE - dt.timedelta(days=WINDOW_DAYS)
            tr = f"play_date <= {_d(cut)}"
            te = f"play_date > {_d(cut)} AND play_date <= {_d(EVAL_DATE)}"
        for part, cond in (("train", tr), ("test", te)):
            parts.append(f"""SELECT '{split}' AS split, '{part}' AS part,
                count(*) AS n_events, count(DISTINCT up_id) AS n_users,
                count(DISTINCT video_id) AS n_items, min(play_date) AS first_day,
                max(play_date) AS last_day FROM hist WHERE {cond}""")
    out["holdout_split"] = _simple("\nUNION ALL\n".join(parts))

    for name, label, split in (("precision_user", "user", "code"),
                               ("precision_city", "reside_city", "code"),
                               ("precision_phone", "phone_type", "code"),
                               ("precision_user_holdout", "user", "holdout")):
        q = Q()
        out[name] = q.render(q.precision("pr", label, split))

    def kl_query():
        q = Q()
        o = q.user_dist("ko", "hist", None, KL_SPLIT)
        n = q.user_dist("kn", "hist", KL_SPLIT, TO_DATE)
        return q, q.kl("kl", o, n, ["up_id"])

    q, k = kl_query()
    out["kl_user"] = q.render(f"SELECT up_id, round(kl, {ROUND}) AS kl FROM {k}")
    q, k = kl_query()
    out["kl_user_dense"] = q.render(f"SELECT up_id, round(kl, {ROUND}) AS kl FROM {k}")
    q = Q()
    o = q.user_dist("ko", "hist", None, KL_SPLIT)
    n = q.user_dist("kn", "hist", KL_SPLIT, TO_DATE)
    k = q.kl("kl", n, o, ["up_id"])
    out["kl_user_reverse"] = q.render(f"SELECT up_id, round(kl, {ROUND}) AS kl FROM {k}")
    q, k = kl_query()
    out["kl_summary"] = q.render(f"SELECT {_summary_cols()} FROM {k}")

    out["weekly_drift"] = _drift(Q(), TO_DATE, WEEKS, OFFSET_WEEKS)
    out["weekly_drift_offset"] = _drift(Q(), TO_DATE, SHIFTED_WEEKS, SHIFT, reverse=True)
    out["weekly_drift_gaps"] = _drift(Q(), GAP_DATE, GAP_WEEKS)
    out["drift_windows"] = _drift(Q(), TO_DATE, WINDOWS, days=WINDOW_LENGTH)
    out["job_stat"] = _drift(Q(), TO_DATE, SHIFTED_WEEKS)
    q = Q()
    q.add("ev", """SELECT user_id AS up_id, event_type AS video_id, CAST(ts AS DATE) AS play_date
        FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND event_type <> ''
          AND ts IS NOT NULL""")
    q.add("etok", """SELECT DISTINCT video_id, unnest(list_distinct([video_id, substr(video_id, 1, 1)])) AS tag FROM ev""")
    q.add("elong", """SELECT t.video_id, d.tag_idx FROM etok t JOIN (
        SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_idx FROM (SELECT DISTINCT tag FROM etok) v) d
        ON t.tag = d.tag""")
    out["weekly_drift_events"] = _drift(q, EVENTS_TO, EVENT_WEEKS, hist="ev", long="elong")

    q = _dist_user()
    out["saved_distribution"] = q.render("SELECT up_id, tag_idx, n, total, prob FROM du")
    out["saved_distribution_table"] = out["saved_distribution"]
    q = Q()
    d = q.label_dist("dl", "reside_city", "hist", DIST_FROM, TO_DATE)
    out["saved_distribution_city"] = q.render(f"SELECT reside_city, tag_idx, n, total, prob FROM {d}")
    q = Q()
    d = q.label_dist("dl", "phone_type", "hist", DIST_FROM, TO_DATE)
    out["saved_distribution_dense"] = q.render(_dense(q, d, "phone_type"))
    q, r = recs_user()
    mh = _multi_hot_sql(q)
    out["enriched_recs"] = q.render(f"""SELECT r.video_id, r.up_id, r.prob_sum, r.pop, r.rank,
        m.tags FROM {r} r JOIN {mh} m ON r.video_id = m.video_id""")
    q, r = recs_user()
    mh = _multi_hot_sql(q)
    d = q.user_dist("ds", "hist", DIST_FROM, TO_DATE)
    out["saved_recs_table"] = q.render(f"""SELECT l.up_id, l.n_rows, l.last_rank, e.tag_events
        FROM (SELECT r.up_id, count(*) AS n_rows, max(r.rank) AS last_rank
              FROM {r} r JOIN {mh} m ON r.video_id = m.video_id GROUP BY r.up_id) l
        JOIN (SELECT up_id, CAST(sum(n) AS BIGINT) AS tag_events FROM {d} GROUP BY up_id) e ON e.up_id = l.up_id""")
    for name, col in (("saved_recs_user", None), ("saved_recs_city", "reside_city"), ("job_rec", "phone_type")):
        q = Q()
        r = q.two_window("tw", "hist", TO_DATE, WINDOW_DAYS, col)
        mh = _multi_hot_sql(q)
        out[name] = q.render(f"""SELECT r.video_id, r.up_id, r.rank, r.source, m.tags
            FROM {r} r JOIN {mh} m ON r.video_id = m.video_id""")
    q = Q()
    d = q.label_dist("dt", "reside_city", "hist", DIST_FROM, EVAL_DATE)
    precision = q.precision("pr", "reside_city", "code")
    out["job_train"] = q.render(f"""SELECT s.rows_stored, s.events_stored, p.hits, p.recommended, p.precision
        FROM (SELECT count(*) AS rows_stored, CAST(sum(n) AS BIGINT) AS events_stored FROM {d}) s
        CROSS JOIN ({precision}) p""")
    return out


ORACLE_SQL = build()
