"""DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each operator's semantics independently of the Spark code:
splits by ``row_number`` over the md5 key, chunks by list slicing, training
epochs unrolled as CTEs, and so on.  ``Sql`` accumulates named CTEs so the
long pipeline chains stay readable.
"""

from __future__ import annotations

import math
import re

from quire.plans.catalog import BASELINE_CFG, BINARY_CFG, N_FOLDS, PIPE_CFG, R
from quire.plans import corpora
from quire.plans.pipelines import FusedConfig
from quire.operators.splits import GIVEN, RECIPES
from quire.operators.params import FUSED_ID
from quire.operators.training_sets import TASK_NAME

TERM_RE = r"[\p{L}\p{N}]+"


class Sql:
    def __init__(self):
        self.ctes: list[tuple[str, str]] = []
        self.n = 0

    def add(self, sql: str, name: str | None = None) -> str:
        self.n += 1
        name = name or f"t{self.n}"
        self.ctes.append((name, sql))
        return name

    def render(self, final: str) -> str:
        if not self.ctes:
            return final
        # What several others read is computed once, whatever the planner would choose.
        texts = [s for _, s in self.ctes] + [final]
        used = {n: sum(len(re.findall(rf"\b{n}\b", s)) for s in texts) for n, _ in self.ctes}
        return "WITH " + ",\n".join(
            f"{n} AS {'MATERIALIZED ' if used[n] > 1 else ''}(\n{s}\n)" for n, s in self.ctes) + "\n" + final


def cols(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_{c}" for c in range(k)]


def rnd(expr: str, alias: str) -> str:
    return f"round({expr}, {R}) AS {alias}"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# -- splits ------------------------------------------------------------------

def key_sql(seed: int = 777, col: str = "doc_id") -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


def bucket_sql(seed: int = 777, buckets: int = 1000, col: str = "doc_id") -> str:
    return f"CAST((('0x' || substr({key_sql(seed, col)}, 1, 8))::UBIGINT % {buckets}) AS INTEGER)"


def bits_sql(seed: int = 777, col: str = "doc_id") -> str:
    return f"('0x' || substr({key_sql(seed, col)}, 1, 8))::UBIGINT"


def exact_step(q: Sql, src: str, part: str, second: str, frac: float) -> str:
    return q.add(f"""SELECT * EXCLUDE (split),
  CASE WHEN split = '{part}' AND row_number() OVER (PARTITION BY split ORDER BY __k)
            <= ceil(count(*) OVER (PARTITION BY split) * {dbl(frac)}) THEN '{second}' ELSE split END AS split
FROM {src}""")


def hash_step(q: Sql, src: str, part: str, second: str, frac: float, seed: int = 777) -> str:
    return q.add(f"""SELECT * EXCLUDE (split),
  CASE WHEN split = '{part}' AND {bits_sql(seed)} < {math.ceil(frac * 2 ** 32)} THEN '{second}' ELSE split END AS split
FROM {src}""")


def recipe(q: Sql, src: str, name: str, seed: int = 777) -> str:
    """``src`` has ``doc_id`` (+ any columns); result adds ``__k`` and ``split``."""
    if name in GIVEN:
        whens, upper = [], 0
        for part, width in GIVEN[name]:
            upper += width
            whens.append(f"WHEN {bucket_sql(seed + 1)} < {upper} THEN '{part}'")
        first = f"CASE {' '.join(whens)} ELSE '{GIVEN[name][-1][0]}' END"
    else:
        first = "'train'"
    cur = q.add(f"SELECT *, {key_sql(seed)} AS __k, {first} AS split FROM {src}")
    for part, second, frac, exact in RECIPES[name]:
        cur = exact_step(q, cur, part, second, frac) if exact else hash_step(q, cur, part, second, frac, seed)
    return cur


# -- chunks and features ------------------------------------------------------------------

def chunk_sql(q: Sql, src: str, keep: list[str], n_regions: int = 3, max_tokens: int | None = 400,
              unit: str = "word", text: str = "text") -> str:
    kc = ", ".join(keep)
    if unit == "word":
        tok = f"string_split({text}, ' ')"
    elif unit == "char":
        tok = f"string_split(array_to_string(string_split({text}, ''), ' '), ' ')"
    else:
        raise ValueError(unit)
    t = q.add(f"SELECT {kc}, {tok} AS __tok FROM {src}")
    r = q.add(f"SELECT *, len(__tok) AS __n, unnest(range({n_regions})) AS __region FROM {t}")
    r2 = q.add(f"""SELECT *, __region * (__n // {n_regions}) + least(__region, __n % {n_regions}) AS __rs,
  __n // {n_regions} + CASE WHEN __region < __n % {n_regions} THEN 1 ELSE 0 END AS __rl FROM {r}""")
    ksub = "1" if max_tokens is None else f"CASE WHEN __rl > {max_tokens} THEN __rl // {max_tokens} + 1 ELSE 1 END"
    r3 = q.add(f"SELECT *, {ksub} AS __kk FROM {r2}")
    c = q.add(f"SELECT *, unnest(range(__kk)) AS __sub FROM {r3}")
    start = "__rs + __sub * (__rl // __kk) + least(__sub, __rl % __kk)"
    length = "__rl // __kk + CASE WHEN __sub < __rl % __kk THEN 1 ELSE 0 END"
    return q.add(f"""SELECT {kc}, CAST(__region AS INTEGER) AS region, CAST(__sub AS INTEGER) AS sub,
  array_to_string(list_slice(__tok, {start} + 1, {start} + {length}), ' ') AS chunk FROM {c}""")


def term_counts_sql(q: Sql, chunks: str, carry: list[str]) -> str:
    cc = "".join(f", {c}" for c in carry)
    t = q.add(f"SELECT doc_id, region, sub{cc}, regexp_extract_all(lower(chunk), '{TERM_RE}') AS __t FROM {chunks}")
    x = q.add(f"SELECT doc_id, region, sub{cc}, len(__t) AS n_terms, unnest(__t) AS term FROM {t}")
    g = q.add(f"SELECT doc_id, region, sub{cc}, n_terms, term, count(*) AS cnt FROM {x} GROUP BY ALL")
    return q.add(f"""SELECT *, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id, region, sub)) AS tf FROM {g}""")


# -- the fused plan ------------------------------------------------------------------

class PlanSql:
    """SQL mirror of :class:`quire.plans.pipelines.FusedPlan`."""

    def __init__(self, cfg: FusedConfig, k: int, source: str | None = None):
        self.cfg, self.k = cfg, k
        self.q = Sql()
        q = self.q
        src = source or f"SELECT doc_id, text, {cfg.label_col} AS label FROM documents"
        base = q.add(src, "docs")
        self.split = recipe(q, base, cfg.recipe, cfg.seed)
        self.label_map = q.add(f"""SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
FROM (SELECT DISTINCT label FROM {self.split} WHERE split = 'train' AND label IS NOT NULL)""", "label_map")
        enc = q.add(f"""SELECT s.doc_id, s.text, s.split, s.label,
  CASE WHEN s.split = 'test' THEN NULL ELSE m.label_idx END AS label_idx
FROM {self.split} s LEFT JOIN {self.label_map} m ON s.label = m.label""")
        self.chunks = chunk_sql(q, enc, ["doc_id", "split", "label", "label_idx"], cfg.n_regions, cfg.max_tokens,
                                cfg.unit)
        counts = term_counts_sql(q, self.chunks, ["split", "label_idx"])
        self.vocab = q.add(f"""SELECT term, row_number() OVER (ORDER BY term) AS term_id
FROM (SELECT DISTINCT term FROM {counts} WHERE split = 'train')""", "vocab")
        self.features = q.add(f"SELECT c.*, v.term_id FROM {counts} c JOIN {self.vocab} v ON v.term = c.term", "features")
        self._memo: dict = {}

    # samples / features of some splits for one model id expression
    def samples(self, splits, model: str, labelled: bool) -> str:
        key = ("s", tuple(splits), model, labelled)
        if key not in self._memo:
            sp = ", ".join(f"'{s}'" for s in splits)
            cond = " AND label_idx IS NOT NULL" if labelled else ""
            self._memo[key] = self.q.add(f"""SELECT doc_id, region, sub, CAST({model} AS INTEGER) AS model_id, label_idx
FROM {self.chunks} WHERE split IN ({sp}){cond}""")
        return self._memo[key]

    def feats(self, splits, model: str, labelled: bool) -> str:
        key = ("f", tuple(splits), model, labelled)
        if key not in self._memo:
            sp = ", ".join(f"'{s}'" for s in splits)
            cond = " AND label_idx IS NOT NULL" if labelled else ""
            self._memo[key] = self.q.add(f"""SELECT doc_id, region, sub, CAST({model} AS INTEGER) AS model_id, label_idx, term_id, tf
FROM {self.features} WHERE split IN ({sp}){cond}""")
        return self._memo[key]

    def init_params(self, model_ids: list[int]) -> str:
        k = self.k
        z = ", ".join(f"CAST(0.0 AS DOUBLE) AS {w}" for w in cols("w", k))
        ids = "[" + ", ".join(str(int(m)) for m in model_ids) + "]"
        return self.q.add(f"""SELECT CAST(unnest({ids}) AS INTEGER) AS model_id, 'body' AS part, v.term AS param, v.term_id AS param_id, {z}
FROM {self.vocab} v
UNION ALL
SELECT CAST(unnest({ids}) AS INTEGER), 'head', 'bias', -1, {z}""")

    def logits(self, params: str, samples: str, feats: str) -> str:
        k, q = self.k, self.q
        sums = ", ".join(f"sum(f.tf * b.{w}) AS {s}" for w, s in zip(cols("w", k), cols("s", k)))
        dots = q.add(f"""SELECT f.doc_id, f.region, f.sub, {sums}
FROM {feats} f JOIN {params} b ON b.part = 'body' AND b.model_id = f.model_id AND b.param_id = f.term_id
GROUP BY f.doc_id, f.region, f.sub, f.model_id""")
        ls = ", ".join(f"coalesce(d.{s}, 0.0) + coalesce(h.{w}, 0.0) AS {l}"
                       for s, w, l in zip(cols("s", k), cols("w", k), cols("l", k)))
        return q.add(f"""SELECT s.doc_id, s.region, s.sub, s.model_id, s.label_idx, {ls}
FROM {samples} s LEFT JOIN {dots} d ON d.doc_id = s.doc_id AND d.region = s.region AND d.sub = s.sub
LEFT JOIN {params} h ON h.part = 'head' AND h.model_id = s.model_id""")

    def probs(self, logits: str) -> str:
        k = self.k
        m = f"greatest({', '.join(cols('l', k))})" if k > 1 else "l_0"
        tot = " + ".join(f"exp(l_{c} - __m)" for c in range(k))
        ps = ", ".join(f"exp(l_{c} - __m) / ({tot}) AS p_{c}" for c in range(k))
        inner = self.q.add(f"SELECT *, {m} AS __m FROM {logits}")
        return self.q.add(f"SELECT doc_id, region, sub, model_id, label_idx, {ps} FROM {inner}")

    def step(self, params: str, samples: str, feats: str, lr: float) -> str:
        k, q = self.k, self.q
        pr = self.probs(self.logits(params, samples, feats))
        es = ", ".join(f"p_{c} - CASE WHEN label_idx = {c} THEN 1.0 ELSE 0.0 END AS e_{c}" for c in range(k))
        res = q.add(f"SELECT doc_id, region, sub, model_id, {es} FROM {pr}")
        hg = q.add(f"SELECT model_id, count(*) AS n, {', '.join(f'sum(e_{c}) AS gh_{c}' for c in range(k))} FROM {res} GROUP BY model_id")
        bg = q.add(f"""SELECT r.model_id, f.term_id, {', '.join(f'sum(f.tf * r.e_{c}) AS gb_{c}' for c in range(k))}
FROM {feats} f JOIN {res} r ON r.doc_id = f.doc_id AND r.region = f.region AND r.sub = f.sub
GROUP BY r.model_id, f.term_id""")
        body = ", ".join(f"b.w_{c} - {dbl(lr)} * coalesce(g.gb_{c} / h.n, 0.0) AS w_{c}" for c in range(k))
        head = ", ".join(f"b.w_{c} - {dbl(lr)} * coalesce(h.gh_{c} / h.n, 0.0) AS w_{c}" for c in range(k))
        return q.add(f"""SELECT b.model_id, 'body' AS part, b.param, b.param_id, {body}
FROM {params} b LEFT JOIN {bg} g ON g.model_id = b.model_id AND g.term_id = b.param_id
LEFT JOIN {hg} h ON h.model_id = b.model_id WHERE b.part = 'body'
UNION ALL
SELECT b.model_id, 'head', 'bias', -1, {head}
FROM {params} b LEFT JOIN {hg} h ON h.model_id = b.model_id WHERE b.part = 'head'""")

    def loss(self, params: str, samples: str, feats: str) -> str:
        k = self.k
        pr = self.probs(self.logits(params, samples, feats))
        pt = "CASE " + " ".join(f"WHEN label_idx = {c} THEN p_{c}" for c in range(k)) + " END"
        return self.q.add(f"""SELECT model_id, count(*) AS n, avg(-ln(greatest({pt}, 1e-300))) AS loss
FROM {pr} GROUP BY model_id""")

    def fit(self, params: str, samples: str, feats: str, dev_s: str | None, dev_f: str | None, lr: float,
            epochs: int) -> tuple[str, str]:
        """Returns (final params, history) CTE names."""
        q = self.q
        per_epoch, losses = [], []
        cur = params
        for e in range(1, epochs + 1):
            cur = self.step(cur, samples, feats, lr)
            per_epoch.append(cur)
            if dev_s is not None:
                lo = self.loss(cur, dev_s, dev_f)
                losses.append(q.add(f"SELECT model_id, {e} AS epoch, loss FROM {lo}"))
        hist_all = q.add(" UNION ALL ".join(f"SELECT * FROM {x}" for x in losses))
        ranked = q.add(f"""SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY loss, epoch) = 1 AS best
FROM {hist_all}""")
        hist = q.add(f"SELECT CAST(model_id AS INTEGER) AS model_id, CAST(epoch AS INTEGER) AS epoch, loss AS dev_loss, best FROM {ranked}")
        final = q.add(" UNION ALL ".join(
            f"SELECT p.* FROM {p} p WHERE p.model_id IN (SELECT model_id FROM {hist} WHERE best AND epoch = {e})"
            for e, p in enumerate(per_epoch, start=1)))
        return final, hist

    def batch(self, rows: str, number: int) -> str:
        key = f"md5('{self.cfg.seed}:' || doc_id || ':' || region || ':' || sub)"
        return self.q.add(f"SELECT * FROM {rows} WHERE ('0x' || substr({key}, 1, 8))::UBIGINT % {self.cfg.batches} = {number}")

    def adam_step(self, params: str, samples: str, feats: str, lr: float, step: int) -> str:
        """``params`` has moments; a gradient step of rate 1 from zero weights' place gives the mean gradient."""
        k, q = self.k, self.q
        moved = self.step(params, samples, feats, 1.0)  # w - g
        sel = []
        for c in range(k):
            g = f"(b.w_{c} - n.w_{c})"
            m = f"({dbl(0.9)} * b.m_{c} + {dbl(1 - 0.9)} * {g})"
            v = f"({dbl(0.999)} * b.v_{c} + {dbl(1 - 0.999)} * {g} * {g})"
            sel.append(f"b.w_{c} - {dbl(lr)} * ({m} / {dbl(1 - 0.9 ** step)}) / (sqrt({v} / {dbl(1 - 0.999 ** step)}) + {dbl(1e-8)}) AS w_{c}, "
                       f"{m} AS m_{c}, {v} AS v_{c}")
        return q.add(f"""SELECT b.model_id, b.part, b.param, b.param_id, {', '.join(sel)}
FROM {params} b JOIN {moved} n ON n.model_id = b.model_id AND n.param_id = b.param_id""")

    def batch_fit(self) -> tuple[str, str]:
        """(final params, history) of the mini-batch steps."""
        c, q, k = self.cfg, self.q, self.k
        zeros = ", ".join(f"CAST(0.0 AS DOUBLE) AS {x}" for x in cols("m", k) + cols("v", k))
        cur = q.add(f"SELECT *, {zeros} FROM {self.init_params(list(range(c.n_regions)))}")
        s, f = self.samples(["train"], "region", True), self.feats(["train"], "region", True)
        ds, df = self.samples(["dev"], "region", True), self.feats(["dev"], "region", True)
        parts = [(self.batch(s, b), self.batch(f, b)) for b in range(c.batches)]
        kept, losses, last = {}, [], c.epochs * c.batches
        for step in range(1, last + 1):
            cur = self.adam_step(cur, *parts[(step - 1) % c.batches], c.batch_lr, step)
            if step % c.eval_every == 0 or step == last:
                kept[step] = cur
                losses.append(q.add(f"SELECT model_id, CAST({step} AS INTEGER) AS step, loss FROM {self.loss(cur, ds, df)}"))
        return self.best(kept, losses)

    def best(self, kept: dict[int, str], losses: list[str]) -> tuple[str, str]:
        q = self.q
        told = q.add(" UNION ALL ".join(f"SELECT * FROM {x}" for x in losses))
        hist = q.add(f"""SELECT model_id, step, loss AS dev_loss, row_number() OVER (PARTITION BY model_id ORDER BY loss, step) = 1 AS best
FROM {told}""")
        final = q.add(" UNION ALL ".join(f"SELECT p.* FROM {p} p WHERE p.model_id IN (SELECT model_id FROM {hist} WHERE best AND step = {n})"
                                         for n, p in kept.items()))
        return final, hist

    def local_fit(self) -> tuple[str, str]:
        """(final params, history) of the steps inside shards: a model's copy in a shard is a model of its own."""
        c, q, k = self.cfg, self.q, self.k
        s, f = self.samples(["train"], "region", True), self.feats(["train"], "region", True)
        n = q.add(f"SELECT CAST(greatest(1, ceil(count(*) / {c.shard_rows})) AS BIGINT) AS n FROM {s}")
        key = f"md5('{c.seed + 1}:' || CAST(r.doc_id AS VARCHAR) || ':' || CAST(r.region AS VARCHAR) || ':' || CAST(r.sub AS VARCHAR))"
        own = lambda rows: q.add(f"""SELECT r.* REPLACE (r.model_id * n.n + CAST(('0x' || substr({key}, 1, 8))::UBIGINT % n.n AS BIGINT) AS model_id)
FROM {rows} r, {n} n""")  # noqa: E731
        own_s, own_f = own(s), own(f)
        parts = [(self.batch(own_s, b), self.batch(own_f, b)) for b in range(c.batches)]
        ds, df = self.samples(["dev"], "region", True), self.feats(["dev"], "region", True)
        cur = self.init_params(list(range(c.n_regions)))
        kept, losses = {}, []
        for step in range(1, c.epochs + 1):
            copies = q.add(f"SELECT p.* REPLACE (p.model_id * n.n + x.i AS model_id) FROM {cur} p, {n} n, (SELECT unnest(range(n)) AS i FROM {n}) x")
            for part in parts:
                copies = self.step(copies, *part, c.lr)
            cur = q.add(f"""SELECT CAST(p.model_id // n.n AS INTEGER) AS model_id, p.part, p.param, p.param_id, {', '.join(f'avg(p.{w}) AS {w}' for w in cols('w', k))}
FROM {copies} p, {n} n GROUP BY p.model_id // n.n, p.part, p.param, p.param_id""")
            kept[step] = cur
            losses.append(q.add(f"SELECT model_id, CAST({step} AS INTEGER) AS step, loss FROM {self.loss(cur, ds, df)}"))
        return self.best(kept, losses)

    # stages
    def region_fit(self):
        if "region_fit" not in self._memo:
            c = self.cfg
            init = self.init_params(list(range(c.n_regions)))
            self._memo["region_fit"] = self.fit(
                init, self.samples(["train"], "region", True), self.feats(["train"], "region", True),
                self.samples(["dev"], "region", True), self.feats(["dev"], "region", True), c.lr, c.epochs)
        return self._memo["region_fit"]

    def base(self) -> str:
        if "base" not in self._memo:
            self._memo["base"] = self.init_params([FUSED_ID])
        return self._memo["base"]

    def fused(self) -> str:
        if "fused" not in self._memo:
            k, q, c = self.k, self.q, self.cfg
            models, _ = self.region_fit()
            n = c.n_regions
            avg = q.add(f"""SELECT part, param_id, {', '.join(f'sum({w} * (1.0::DOUBLE / {n})) AS {w}' for w in cols('w', k))}
FROM {models} WHERE part = 'body' GROUP BY part, param_id""")
            vals = ", ".join(f"CASE WHEN b.part IN ('body') AND a.{w} IS NOT NULL THEN a.{w} ELSE b.{w} END AS {w}"
                             for w in cols("w", k))
            self._memo["fused"] = q.add(f"""SELECT CAST({FUSED_ID} AS INTEGER) AS model_id, b.part, b.param, b.param_id, {vals}
FROM {self.base()} b LEFT JOIN {avg} a ON a.part = b.part AND a.param_id = b.param_id""")
        return self._memo["fused"]

    def finetune_fit(self):
        if "ft" not in self._memo:
            c = self.cfg
            m = str(FUSED_ID)
            self._memo["ft"] = self.fit(self.fused(), self.samples(["finetune"], m, True),
                                        self.feats(["finetune"], m, True), self.samples(["dev"], m, True),
                                        self.feats(["dev"], m, True), c.finetune_lr, c.finetune_epochs)
        return self._memo["ft"]

    def scores(self, params: str) -> str:
        m = str(FUSED_ID)
        return self.logits(params, self.samples(["test"], m, False), self.feats(["test"], m, False))

    def chunk_probs(self, params: str) -> str:
        return self.probs(self.scores(params))

    def doc_probs(self, params: str) -> str:
        k = self.k
        return self.q.add(f"SELECT doc_id, {', '.join(f'avg(p_{c}) AS p_{c}' for c in range(k))} FROM {self.chunk_probs(params)} GROUP BY doc_id")

    def doc_argmax(self, params: str) -> str:
        return self.q.add(f"SELECT *, {argmax_sql(self.k)} AS prediction_idx FROM {self.doc_probs(params)}")

    def doc_predictions(self, params: str) -> str:
        return self.q.add(f"""SELECT d.*, m.label AS prediction FROM {self.doc_argmax(params)} d
LEFT JOIN {self.label_map} m ON m.label_idx = d.prediction_idx""")

    def with_gold(self, params: str) -> str:
        return self.q.add(f"""SELECT d.*, s.label AS gold FROM {self.doc_predictions(params)} d
JOIN {self.split} s ON s.doc_id = d.doc_id AND s.split = 'test'""")


def argmax_sql(k: int, prefix: str = "p") -> str:
    if k == 1:
        return "0"
    parts = []
    for c in range(k - 1):
        cond = " AND ".join(f"{prefix}_{c} >= {prefix}_{d}" for d in range(c + 1, k))
        parts.append(f"WHEN {cond} THEN {c}")
    return f"CAST(CASE {' '.join(parts)} ELSE {k - 1} END AS INTEGER)"


MET = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "macro_f1", "micro_f1"]


def per_label_sql(q: Sql, src: str, group: list[str] = ()) -> str:
    g = "".join(f"{c}, " for c in group)
    conf = q.add(f"SELECT {g}CAST(gold AS VARCHAR) AS gold, CAST(prediction AS VARCHAR) AS pred, count(*) AS n FROM {src} GROUP BY ALL")
    gs = q.add(f"""SELECT {g}gold AS label, CAST(sum(n) AS BIGINT) AS support,
  CAST(sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS BIGINT) AS tp FROM {conf} GROUP BY ALL""")
    ps = q.add(f"SELECT {g}pred AS label, CAST(sum(n) AS BIGINT) AS n_pred FROM {conf} GROUP BY ALL")
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in list(group) + ["label"])
    gsel = "".join(f"coalesce(a.{c}, b.{c}) AS {c}, " for c in group)
    j = q.add(f"""SELECT {gsel}coalesce(a.label, b.label) AS label, coalesce(a.support, 0) AS support,
  coalesce(b.n_pred, 0) AS n_pred, coalesce(a.tp, 0) AS tp
FROM {gs} a FULL OUTER JOIN {ps} b ON {on}""")
    return q.add(f"""SELECT {g}label, support, n_pred, tp,
  CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
  CASE WHEN support + n_pred > 0 THEN 2.0 * tp / (support + n_pred) ELSE 0.0 END AS f1
FROM {j}""")


def metrics_sql(q: Sql, src: str, group: list[str] = ()) -> str:
    pl = per_label_sql(q, src, group)
    g = "".join(f"{c}, " for c in group)
    gb = f" GROUP BY {', '.join(group)}" if group else ""
    return q.add(f"""SELECT {g}CAST(sum(support) AS BIGINT) AS n,
  sum(tp) / sum(support) AS accuracy,
  sum(precision * support) / sum(support) AS weighted_precision,
  sum(recall * support) / sum(support) AS weighted_recall,
  sum(f1 * support) / sum(support) AS weighted_f1,
  avg(f1) AS macro_f1,
  sum(tp) / sum(support) AS micro_f1
FROM {pl}{gb}""")


def metrics_final(q: Sql, src: str) -> str:
    m = metrics_sql(q, src)
    return q.render(f"SELECT n, {', '.join(rnd(c, c) for c in MET)} FROM {m}")


def params_final(q: Sql, params: str, k: int) -> str:
    return q.render(f"SELECT model_id, part, param, {', '.join(rnd(w, w) for w in cols('w', k))} FROM {params}")


# -- per-query SQL ------------------------------------------------------------------

K_LANG = 4    # four languages in the driver's documents
K_BINARY = 2

ROLE_SIZES = """SELECT conv_id,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS n_user,
  sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS n_assistant,
  sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS n_system,
  sum(CASE WHEN role = 'tool' THEN 1 ELSE 0 END) AS n_tool
FROM conversations GROUP BY conv_id"""

WORDS = "len(string_split(text, ' '))"


def _pipe(cfg=PIPE_CFG, k=K_LANG, source=None) -> PlanSql:
    return PlanSql(cfg, k, source)


def _recipe_sql(name: str) -> str:
    q = Sql()
    src = q.add("SELECT doc_id FROM documents")
    out = recipe(q, src, name)
    return q.render(f"SELECT doc_id, split FROM {out}")


def _doc_chunks(q: Sql) -> str:
    src = q.add("SELECT doc_id, text, lang AS label FROM documents")
    return chunk_sql(q, src, ["doc_id", "label"], 3, 400, "word")


def _generated(p: PlanSql) -> str:
    return p.q.add(f"""SELECT doc_id, region, sub, '{TASK_NAME}:' || chunk AS prompt,
  CAST(generate_subscripts(string_split(chunk, ' '), 1) - 1 AS INTEGER) AS sample,
  unnest(string_split(chunk, ' ')) AS generated FROM {p.chunks} WHERE split = 'test'""")


def _integers(q: Sql, src: str, keep: str) -> str:
    return q.add(rf"""SELECT * FROM (SELECT {keep},
  CASE WHEN regexp_full_match(generated, '\s*[+-]?[0-9]+(_[0-9]+)*\s*')
       THEN TRY_CAST(replace(regexp_replace(generated, '^\s+|\s+$', '', 'g'), '_', '') AS BIGINT) END AS prediction
FROM {src}) WHERE prediction IS NOT NULL""")


def _parsed(p: PlanSql) -> str:
    return _integers(p.q, _generated(p), "doc_id, region, sub, sample")


def _votes(p: PlanSql) -> str:
    return p.q.add(f"SELECT doc_id, max(prediction) AS prediction FROM {_parsed(p)} GROUP BY doc_id")


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["length_bands"] = f"""SELECT {rnd(f"sum(CASE WHEN n <= 512 THEN 1 ELSE 0 END) * 100.0 / count(*)", "pct_below")},
  {rnd("sum(CASE WHEN n > 512 AND n <= 4096 THEN 1 ELSE 0 END) * 100.0 / count(*)", "pct_between")},
  {rnd("sum(CASE WHEN n > 4096 THEN 1 ELSE 0 END) * 100.0 / count(*)", "pct_above")}
FROM (SELECT {WORDS} AS n FROM documents)"""
    o["class_counts_any"] = f"""SELECT CAST(CASE WHEN n_system + n_tool = 0 THEN 0 ELSE 1 END AS INTEGER) AS label, count(*) AS n
FROM ({ROLE_SIZES}) GROUP BY 1"""
    o["class_counts_all"] = f"""SELECT CAST(CASE WHEN n_user > 0 AND n_assistant > 0 AND n_system > 0 THEN 1 ELSE 0 END AS INTEGER) AS label, count(*) AS n
FROM ({ROLE_SIZES}) GROUP BY 1"""
    o["rationale_label"] = f"SELECT conv_id, CAST(n_assistant > 0 AS INTEGER) AS labels FROM ({ROLE_SIZES})"
    o["rename_cast_label"] = "SELECT doc_id, CAST(quality AS VARCHAR) AS labels FROM labels"
    o["flatten_whitespace"] = r"SELECT doc_id, regexp_replace(text, '\r\n|[\r\n\t]', ' ', 'g') AS text FROM documents"
    o["paragraph_words"] = """SELECT conv_id, count(*) AS n_paragraphs, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_words,
  CAST(sum(len(list_filter(string_split(text, ' '), lambda t: t = ''))) AS BIGINT) AS n_empty
FROM conversations GROUP BY conv_id"""
    q = Sql()
    src = q.add("SELECT item_id, text FROM benchmark")
    o["char_chunks"] = q.render(f"SELECT * FROM {chunk_sql(q, src, ['item_id'], 3, 400, 'char')}")
    o["chunk_histogram"] = f"""SELECT CAST({WORDS} // 510 + 1 AS INTEGER) AS n_chunks, count(*) AS n_docs FROM documents GROUP BY 1"""
    o["long_doc_counts"] = f"""SELECT CAST(max(n) AS INTEGER) AS max_words, CAST(sum(CASE WHEN n > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS over_2000,
  CAST(sum(CASE WHEN n > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS over_5000 FROM (SELECT {WORDS} AS n FROM documents)"""
    o["conclusion_label"] = """SELECT CAST(CASE WHEN lower(source) = 'src0' THEN 0 ELSE 1 END AS INTEGER) AS label, count(*) AS n
FROM documents GROUP BY 1"""
    o["hash_split"] = f"SELECT doc_id, CASE WHEN {bits_sql()} < {math.ceil(0.2 * 2 ** 32)} THEN 'test' ELSE 'train' END AS split FROM documents"
    o["exact_split"] = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {key_sql()}) <= ceil(count(*) OVER () * {dbl(0.2)})
  THEN 'test' ELSE 'train' END AS split FROM documents"""
    for name in ("news", "cases", "crisis", "paragraph", "flagged"):
        o[f"recipe_{name}"] = _recipe_sql(name)

    p = _pipe()
    o["label_map"] = p.q.render(f"SELECT * FROM {p.label_map}")
    p = _pipe()
    o["encode_labels"] = p.q.render(f"SELECT doc_id, split, label, label_idx FROM {p.chunks} WHERE region = 0 AND sub = 0")
    p = _pipe()
    o["decode_labels"] = p.q.render(f"""SELECT c.doc_id, c.split, c.label, c.label_idx, m.label AS decoded
FROM {p.chunks} c LEFT JOIN {p.label_map} m ON m.label_idx = c.label_idx WHERE c.region = 0 AND c.sub = 0""")
    o["sorted_encoder"] = "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx FROM documents"

    q = Sql()
    o["region_chunks"] = q.render(f"SELECT * FROM {_doc_chunks(q)}")
    q = Sql()
    o["region_view"] = q.render(f"SELECT * FROM {_doc_chunks(q)} WHERE region = 1")
    o["token_windows"] = """WITH vocab AS (
  SELECT term, row_number() OVER (ORDER BY term) + 999 AS term_id
  FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM documents)),
pos AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
ids AS (SELECT p.doc_id, p.pos, v.term_id FROM pos p JOIN vocab v ON v.term = p.term),
w AS (SELECT doc_id, CAST(pos // 510 AS INTEGER) AS win, list(term_id ORDER BY pos) AS body FROM ids GROUP BY ALL)
SELECT doc_id, win,
  list_concat([101], body, [102], list_transform(range(greatest(512 - len(body) - 2, 0)), lambda x: 0)) AS input_ids,
  list_concat(list_transform(range(len(body) + 2), lambda x: 1), list_transform(range(greatest(512 - len(body) - 2, 0)), lambda x: 0)) AS attention_mask
FROM w"""
    p = _pipe()
    o["region_training_set"] = p.q.render(
        f"SELECT split, chunk AS text, label_idx AS labels FROM {p.chunks} WHERE region = 0 AND split IN ('train', 'dev')")
    p = _pipe()
    o["union_regions"] = p.q.render(f"SELECT region, chunk AS text, label_idx AS labels FROM {p.chunks} WHERE split = 'finetune'")
    p = _pipe()
    o["prompt_rows"] = p.q.render(f"""SELECT '{TASK_NAME}' AS prefix, chunk AS input_text, CAST(label_idx AS VARCHAR) AS target_text
FROM {p.chunks} WHERE region = 0 AND split = 'train'""")
    p = _pipe()
    o["term_features"] = p.q.render(f"SELECT doc_id, region, sub, term, cnt, {rnd('tf', 'tf')} FROM {p.features}")

    p = _pipe()
    o["fit_region_models"] = params_final(p.q, p.region_fit()[0], K_LANG)
    p = _pipe()
    o["best_epoch"] = p.q.render(f"SELECT model_id, epoch, {rnd('dev_loss', 'dev_loss')}, best FROM {p.region_fit()[1]}")
    emb = """SELECT vec_id AS model_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"""
    o["average_models"] = f"""WITH e AS ({emb}),
g AS (SELECT label, min(model_id) AS first, count(DISTINCT model_id) AS n FROM e GROUP BY label)
SELECT e.label, e.pos, {rnd('sum(e.value * (1.0 / g.n))', 'value')} FROM e JOIN g ON g.label = e.label GROUP BY e.label, e.pos"""
    o["weighted_average"] = f"""WITH e AS ({emb}),
g AS (SELECT label, min(model_id) AS first, count(DISTINCT model_id) AS n FROM e GROUP BY label)
SELECT e.label, e.pos, {rnd('sum(e.value * (CASE WHEN e.model_id = g.first THEN 1.0 ELSE 1.0 + e.model_id % 3 END / g.n))', 'value')}
FROM e JOIN g ON g.label = e.label GROUP BY e.label, e.pos"""
    p = _pipe()
    o["fuse_into"] = params_final(p.q, p.fused(), K_LANG)
    p = _pipe()
    loc = p.q.add(f"SELECT DISTINCT region AS model_id, 'body' AS part, term AS param FROM {p.features} WHERE split = 'train'")
    o["check_compatible"] = p.q.render(f"""SELECT part, param, (SELECT count(DISTINCT model_id) FROM {loc}) AS n_models, n_with_key
FROM (SELECT part, param, count(DISTINCT model_id) AS n_with_key FROM {loc} GROUP BY part, param)
WHERE n_with_key < (SELECT count(DISTINCT model_id) FROM {loc})""")
    p = _pipe()
    o["finetune_step"] = params_final(p.q, p.finetune_fit()[0], K_LANG)

    kl = K_LANG
    p = _pipe()
    o["chunk_scores"] = p.q.render(f"SELECT doc_id, region, sub, {', '.join(rnd(l, l) for l in cols('l', kl))} FROM {p.scores(p.finetune_fit()[0])}")
    p = _pipe()
    o["chunk_softmax"] = p.q.render(f"SELECT doc_id, region, sub, {', '.join(rnd(x, x) for x in cols('p', kl))} FROM {p.chunk_probs(p.finetune_fit()[0])}")
    p = _pipe()
    o["doc_mean_probs"] = p.q.render(f"SELECT doc_id, {', '.join(rnd(x, x) for x in cols('p', kl))} FROM {p.doc_probs(p.finetune_fit()[0])}")
    p = _pipe()
    o["doc_argmax"] = p.q.render(f"SELECT doc_id, {', '.join(rnd(x, x) for x in cols('p', kl))}, prediction_idx FROM {p.doc_argmax(p.finetune_fit()[0])}")
    p = _pipe()
    o["doc_predictions"] = p.q.render(f"SELECT doc_id, {', '.join(rnd(x, x) for x in cols('p', kl))}, prediction_idx, prediction FROM {p.doc_predictions(p.finetune_fit()[0])}")
    p = _pipe()
    o["attach_gold"] = p.q.render(f"SELECT doc_id, {', '.join(rnd(x, x) for x in cols('p', kl))}, prediction_idx, prediction, gold FROM {p.with_gold(p.finetune_fit()[0])}")
    p = _pipe()
    o["parse_generated"] = p.q.render(f"SELECT doc_id, region, sub, sample, prediction FROM {_parsed(p)}")
    p = _pipe()
    o["doc_max_vote"] = p.q.render(f"SELECT * FROM {_votes(p)}")
    pb = _pipe(BINARY_CFG, K_BINARY, "SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
    dp = pb.doc_probs(pb.finetune_fit()[0])
    o["binary_threshold"] = pb.q.render(f"SELECT doc_id, {rnd('p_0', 'p_0')}, {rnd('p_1', 'p_1')}, CAST(CASE WHEN p_0 <= p_1 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM {dp}")

    p = _pipe()
    o["metrics"] = metrics_final(p.q, p.with_gold(p.finetune_fit()[0]))
    p = _pipe()
    pl = per_label_sql(p.q, p.with_gold(p.finetune_fit()[0]))
    o["per_label_report"] = p.q.render(f"SELECT label, support, n_pred, tp, {rnd('precision', 'precision')}, {rnd('recall', 'recall')}, {rnd('f1', 'f1')} FROM {pl}")
    p = _pipe()
    wf = p.q.add(f"SELECT *, {bucket_sql(777, N_FOLDS)} AS fold FROM {p.with_gold(p.finetune_fit()[0])}")
    mf = metrics_sql(p.q, wf, ["fold"])
    o["fold_summary"] = p.q.render(f"""SELECT metric, {rnd('avg(value)', 'mean')}, {rnd('stddev_pop(value)', 'std')} FROM (
  SELECT 'macro_f1' AS metric, macro_f1 AS value FROM {mf} UNION ALL SELECT 'micro_f1', micro_f1 FROM {mf}) GROUP BY metric""")

    p = _pipe()
    o["fused_documents"] = p.q.render(f"SELECT doc_id, prediction, gold FROM {p.with_gold(p.finetune_fit()[0])}")
    p = _pipe()
    o["fuse_only_metrics"] = metrics_final(p.q, p.with_gold(p.fused()))
    q = Sql()
    ans = q.add("""SELECT doc_id, unnest([CASE WHEN toxic = 0 THEN ' ' || quality ELSE quality || '.0' END, '+' || toxic, 'label',
  quality || ' of ' || toxic]) AS generated FROM labels""")
    votes = q.add(f"SELECT doc_id, max(prediction) AS prediction FROM {_integers(q, ans, 'doc_id')} GROUP BY doc_id")
    j = q.add(f"SELECT v.doc_id, v.prediction, l.quality AS gold FROM {votes} v JOIN labels l ON l.doc_id = v.doc_id")
    o["vote_metrics"] = metrics_final(q, j)
    q = Sql()
    src = q.add("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
    o["paragraph_chunks"] = q.render(f"SELECT * FROM {chunk_sql(q, src, ['conv_id'], 3, 400, 'word')}")
    o["fuse_stored"] = f"""WITH e AS ({emb}),
m AS (SELECT label, pos, avg(value) AS value FROM e GROUP BY label, pos)
SELECT CAST({FUSED_ID} AS INTEGER) AS model_id, 'body' AS part, CAST(pos AS VARCHAR) AS param, {rnd('sum(value / (SELECT count(DISTINCT label) FROM m))', 'w_0')}
FROM m GROUP BY pos"""

    def baseline_params(b: PlanSql) -> str:
        return b.q.add(f"SELECT CAST({FUSED_ID} AS INTEGER) AS model_id, part, param, param_id, {', '.join(cols('w', K_LANG))} FROM {b.region_fit()[0]}")

    b = _pipe(BASELINE_CFG)
    o["baseline_docs"] = b.q.render(f"SELECT doc_id, prediction, gold FROM {b.with_gold(baseline_params(b))}")
    b = _pipe(BASELINE_CFG)
    o["baseline_metrics"] = metrics_final(b.q, b.with_gold(baseline_params(b)))
    b = _pipe(BASELINE_CFG)
    o["untrained_docs"] = b.q.render(f"SELECT doc_id, prediction, gold FROM {b.with_gold(b.base())}")
    b = _pipe(BASELINE_CFG)
    o["untrained_metrics"] = metrics_final(b.q, b.with_gold(b.base()))
    p = _pipe()
    o["fit_batches"] = params_final(p.q, p.batch_fit()[0], K_LANG)
    p = _pipe()
    o["best_step"] = p.q.render(f"SELECT model_id, step, {rnd('dev_loss', 'dev_loss')}, best FROM {p.batch_fit()[1]}")
    p = _pipe()
    o["fit_local"] = params_final(p.q, p.local_fit()[0], K_LANG)
    p = _pipe()
    o["best_round"] = p.q.render(f"SELECT model_id, step, {rnd('dev_loss', 'dev_loss')}, best FROM {p.local_fit()[1]}")
    o["average_blocks"] = o["average_models"]
    o["attach_gold_first"] = """SELECT conv_id, role AS gold FROM (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) WHERE r = 1"""
    p = _pipe()
    o["prediction_prompts"] = p.q.render(
        f"SELECT doc_id, region, sub, '{TASK_NAME}:' || chunk AS prompt FROM {p.chunks} WHERE split = 'test'")
    return {**o, **corpora.ORACLE}


ORACLE = build()
