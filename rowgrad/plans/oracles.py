"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

from ..functions import draws


def rounded(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0e0"


def weight(layer: int, i: str, j: str, scale: float = 1.0) -> str:
    divisor = 250.0 * (scale if layer == 0 else 1.0)
    return f"(((({i}) * {31 + 2 * layer} + ({j}) * {17 + 6 * layer}) % 101 - 50) / {divisor:.1f}e0)"


def bias(layer: int, j: str) -> str:
    return f"(((({j}) * 13 + {layer}) % 7 - 3) / 20e0)"


def hashed(key: str, salt: int) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{salt}'), 1, 15))::BIGINT"


SEED = 7
CLASS_ROWS = "SELECT vec_id, label, embedding::DOUBLE[] AS x0 FROM embeddings"
TARGET_ROWS = "SELECT vec_id, embedding[50:64]::DOUBLE[] AS target, embedding[1:49]::DOUBLE[] AS x0 FROM embeddings"
FLAG_ROWS = """SELECT [CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END] AS target,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS x0 FROM lineitem"""
THOUSAND_ROWS = """SELECT CAST(l_linenumber % 3 AS INTEGER) AS part_id, [CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END] AS target,
  [l_quantity / 1000e0, l_extendedprice / 1000e0, l_discount / 1000e0, l_tax / 1000e0] AS x0 FROM lineitem"""


def forward(source: str, widths: list[int], scale: float = 1.0, prefix: str = "f", masked: bool = False) -> tuple[str, str]:
    """CTEs that add ``x1, x2, …`` (the last one holds the scores); and the name of the last CTE.  Hidden units are multiplied by ``mask`` if asked."""
    ctes, name = [f"{prefix}0 AS ({source})"], f"{prefix}0"
    for layer, (n_in, n_out) in enumerate(zip(widths, widths[1:])):
        z = f"list_sum(list_transform(range({n_in}), lambda i: x{layer}[i + 1] * {weight(layer, 'i', 'j', scale)})) + {bias(layer, 'j')}"
        if layer < len(widths) - 2:
            z = f"greatest(0e0, {z}) * mask[j + 1]" if masked else f"greatest(0e0, {z})"
        ctes.append(f"{prefix}{layer + 1} AS (SELECT *, list_transform(range({n_out}), lambda j: {z}) AS x{layer + 1} FROM {name})")
        name = f"{prefix}{layer + 1}"
    return ",\n".join(ctes), name


SOFTMAX_DELTA = """list_transform(range(10), lambda c: exp({s}[c + 1] - list_max({s}))
  / list_sum(list_transform({s}, lambda v: exp(v - list_max({s})))) - CASE WHEN c = label THEN 1e0 ELSE 0e0 END)"""


def backward(source: str, widths: list[int], loss: str, scale: float = 1.0, masked: bool = False) -> tuple[str, str]:
    """For two-stage networks: add the deltas ``d1`` (hidden) and ``d2`` (scores) of every row."""
    ctes, name = forward(source, widths, scale, masked=masked)
    hidden, out = widths[1], widths[2]
    if loss == "xent":
        d2 = SOFTMAX_DELTA.format(s="x2")
    else:
        d2 = f"list_transform(range({out}), lambda c: 2e0 * (x2[c + 1] - target[c + 1]))"
    d1 = f"""list_transform(range({hidden}), lambda h: CASE WHEN x1[h + 1] > 0
      THEN list_sum(list_transform(range({out}), lambda c: {weight(1, 'h', 'c', scale)} * d2[c + 1])) {"* mask[h + 1]" if masked else ""} ELSE 0e0 END)"""
    ctes += f",\nb2 AS (SELECT *, {d2} AS d2 FROM {name}),\nb1 AS (SELECT *, {d1} AS d1 FROM b2)"
    return ctes, "b1"


def gradient(name: str, widths: list[int], by: list[str], weighted: str) -> str:
    """Weighted sums of the row gradients per group, as ``(*by, layer, name, idx, g)``."""
    groups = "".join(f"{b}, " for b in by)
    parts = []
    for layer in (0, 1):
        n_in, n_out = widths[layer], widths[layer + 1]
        d = f"d{layer + 1}[j + 1]"
        parts.append(
            f"SELECT {groups}{layer} AS layer, 'W' AS name, CAST(i * {n_out} + j AS INTEGER) AS idx, sum({weighted} * x{layer}[i + 1] * {d}) AS g"
            f" FROM {name}, range({n_in}) AS ti(i), range({n_out}) AS tj(j) GROUP BY {groups}i, j"
        )
        parts.append(
            f"SELECT {groups}{layer} AS layer, 'b' AS name, CAST(j AS INTEGER) AS idx, sum({weighted} * {d}) AS g"
            f" FROM {name}, range({n_out}) AS tj(j) GROUP BY {groups}j"
        )
    return "\nUNION ALL ".join(parts)


def batches(table: str, key: str, n_parts: int, batch_size: int | str, push_every: int = 5, seed: int = SEED) -> str:
    """``(key, part_id, batch_id, batch_rows, group_id, group_batches)``; size 0 takes whole parts."""
    sized = f"""SELECT {key}, part_id, h, row_number() OVER (PARTITION BY part_id ORDER BY h, {key}) - 1 AS place,
      count(*) OVER (PARTITION BY part_id) AS part_rows
      FROM (SELECT {key}, h, CAST(h % {n_parts} AS INTEGER) AS part_id FROM (SELECT {key}, {hashed(key, seed)} AS h FROM {table}))"""
    if batch_size == 0:
        return f"SELECT {key}, part_id, 0 AS batch_id, CAST(part_rows AS INTEGER) AS batch_rows, 0 AS group_id, 1 AS group_batches FROM ({sized})"
    return f"""SELECT {key}, part_id, CAST(place // bs AS INTEGER) AS batch_id,
      CAST(least(bs, part_rows - (place // bs) * bs) AS INTEGER) AS batch_rows,
      CAST(place // bs // {push_every} AS INTEGER) AS group_id,
      CAST(least({push_every}, (part_rows + bs - 1) // bs - (place // bs // {push_every}) * {push_every}) AS INTEGER) AS group_batches
      FROM (SELECT *, CAST({batch_size} AS BIGINT) AS bs FROM ({sized}))"""


def batched_rows(rows: str, *args, **kw) -> str:
    return f"SELECT r.*, b.* EXCLUDE (vec_id) FROM ({rows}) r JOIN ({batches('embeddings', 'vec_id', *args, **kw)}) b USING (vec_id)"


def start_values(widths: list[int], slots: dict[str, str]) -> str:
    """Formula parameters as ``(layer, name, idx, value, <slots>)``."""
    extra = "".join(f", {v} AS {k}" for k, v in slots.items())
    parts = []
    for layer, (n_in, n_out) in enumerate(zip(widths, widths[1:])):
        w, b = weight(layer, "i", "j"), bias(layer, "j")
        parts.append(f"SELECT {layer} AS layer, 'W' AS name, CAST(i * {n_out} + j AS INTEGER) AS idx, {w} AS value{extra} FROM range({n_in}) AS ti(i), range({n_out}) AS tj(j)")
        parts.append(f"SELECT {layer} AS layer, 'b' AS name, CAST(j AS INTEGER) AS idx, {b} AS value{extra} FROM range({n_out}) AS tj(j)")
    return "\nUNION ALL ".join(parts)


ADAM = {"m": "0.9e0 * p.m + 0.1e0 * g.g", "v": "0.999e0 * p.v + 0.001e0 * g.g * g.g"}
MOMENTUM = {"accum": "0.9995e0 * p.accum + g.g"}
RMSPROP = {"ms": "0.9e0 * p.ms + 0.1e0 * g.g * g.g"}


def change(kind: str, lr: str, t: str) -> str:
    return {
        "adam": f"- {lr} * sqrt(1 - pow(0.999e0, {t})) / (1 - pow(0.9e0, {t})) * m / (sqrt(v) + 1e-8)",
        "momentum": f"- {lr} * accum",
        "rmsprop": f"- {lr} * g / sqrt(ms + 1e-10)",
    }[kind]


SLOTS = {"adam": ADAM, "momentum": MOMENTUM, "rmsprop": RMSPROP}


def update_step(kind: str, lr: str, before: str, grads: str, t: str) -> str:
    """One update of a flat parameter table by a flat gradient table."""
    slots = SLOTS[kind]
    new = ", ".join(f"{e} AS {s}" for s, e in slots.items())
    return f"SELECT layer, name, idx, value {change(kind, lr, t)} AS value, {', '.join(slots)} FROM (SELECT p.layer, p.name, p.idx, p.value, g.g, {new} FROM {before} p JOIN ({grads}) g USING (layer, name, idx))"


def three_updates(kind: str, lr: str, ctes: str, grads: str, widths: list[int], starts: dict[str, str], steps: int = 3) -> str:
    out = [ctes, f"grads AS MATERIALIZED ({grads})", f"p0 AS MATERIALIZED ({start_values(widths, starts)})"]
    for t in range(steps):
        pushed = f"SELECT layer, name, idx, g FROM grads WHERE part_id = {t}"
        out.append(f"p{t + 1} AS MATERIALIZED ({update_step(kind, lr, f'p{t}', pushed, str(t + 1))})")
    slots = "".join(f", {rounded(s)} AS {s}" for s in SLOTS[kind])
    return f"WITH {', '.join(out)} SELECT layer, name, idx, {rounded('value')} AS value{slots}, CAST({steps} AS BIGINT) AS step FROM p{steps}"


AGE = "event_id % 13 * 10000000"
ARRIVED = "ts + to_seconds(event_id % 13 * 10)"


# ---- training of a softmax regression, unrolled -------------------------------------------------


def softmax_gradient(params: str, rows: str, by: str = "") -> str:
    """Flat gradient of ``rows (vec_id, label, x0, w)`` at flat parameters, per ``by``.

    Parameters are packed into one list per class and one list of biases first.
    """
    group = f"{by}, " if by else ""
    return f"""WITH packed AS (
        SELECT list(wl ORDER BY c) AS wc, (SELECT list(value ORDER BY idx) FROM {params} WHERE name = 'b') AS bc
        FROM (SELECT idx % 10 AS c, list(value ORDER BY idx) AS wl FROM {params} WHERE name = 'W' GROUP BY idx % 10)),
      scored AS (SELECT r.*, list_transform(range(10), lambda c: list_dot_product(r.x0, q.wc[c + 1]) + q.bc[c + 1]) AS s FROM ({rows}) r, packed q),
      deltas AS (SELECT *, {SOFTMAX_DELTA.format(s='s')} AS d FROM scored)
      SELECT {group}0 AS layer, 'W' AS name, CAST(i * 10 + j AS INTEGER) AS idx, sum(w * x0[i + 1] * d[j + 1]) AS g
        FROM deltas, range(64) AS ti(i), range(10) AS tj(j) GROUP BY {group}i, j
      UNION ALL SELECT {group}0 AS layer, 'b' AS name, CAST(j AS INTEGER) AS idx, sum(w * d[j + 1]) AS g
        FROM deltas, range(10) AS tj(j) GROUP BY {group}j"""


def softmax_error(params: str, rows: str) -> str:
    return f"""WITH packed AS (
        SELECT list(wl ORDER BY c) AS wc, (SELECT list(value ORDER BY idx) FROM {params} WHERE name = 'b') AS bc
        FROM (SELECT idx % 10 AS c, list(value ORDER BY idx) AS wl FROM {params} WHERE name = 'W' GROUP BY idx % 10)),
      scored AS (SELECT label, list_transform(range(10), lambda c: list_dot_product(r.x0, q.wc[c + 1]) + q.bc[c + 1]) AS s FROM ({rows}) r, packed q)
      SELECT 1 - avg(CASE WHEN list_position(s, list_max(s)) - 1 = label THEN 1e0 ELSE 0e0 END) AS e FROM scored"""


def softmax_training(rows: str, steps: list[tuple[str, str, str]], errors: list[tuple[int, str]], head: str = "", final: str | None = None) -> str:
    """``steps``: (name before, gradient SQL, name after); ``errors``: (step, error SQL)."""
    ctes = [head] if head else []
    ctes.append(f"p0 AS ({start_values([64, 10], {'m': '0e0', 'v': '0e0'})})")
    for t, (before, grads, after) in enumerate(steps, start=1):
        ctes.append(f"{after} AS MATERIALIZED ({update_step('adam', '0.05e0', before, grads, str(t))})")
    last = steps[-1][2]
    if final is None:
        final = f"SELECT name AS item, idx, {rounded('value')} AS value FROM {last}"
        for step, sql in errors:
            final += f"\nUNION ALL SELECT 'error' AS item, {step} AS idx, {rounded('e')} AS value FROM ({sql})"
    else:
        final = final.format(last=last)
    return f"WITH {', '.join(ctes)}\n{final}"


def warmup_sql() -> str:
    head = f"rows AS ({CLASS_ROWS}), sample AS (SELECT *, 1e0 AS w, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS slice FROM rows ORDER BY vec_id LIMIT 150)"
    steps, errors = [], []
    for t in range(3):
        part = f"SELECT vec_id, label, x0, w FROM sample WHERE slice = {t}"
        steps.append((f"p{t}", softmax_gradient(f"p{t}", part), f"p{t + 1}"))
        errors.append((t + 1, softmax_error(f"p{t + 1}", part)))
    return softmax_training("", steps, errors, head)


def rounds_sql(sequential: bool) -> str:
    largest = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY ({hashed('vec_id', SEED)}) % 4))"
    size = f"(({largest} + 5) // 6)"
    head = f"rows AS ({batched_rows(CLASS_ROWS, 4, size, 2)})"
    steps, errors = [], []
    t = 0
    for r in range(3):
        if sequential:
            base = f"p{t}"
            part = f"SELECT vec_id, label, x0, part_id, 1e0 / group_batches AS w FROM rows WHERE group_id = {r}"
            head += f", g{r} AS MATERIALIZED ({{g{r}}})"
            for p in range(4):
                steps.append((f"p{t}", f"SELECT layer, name, idx, g FROM ({softmax_gradient(base, part, 'part_id')}) WHERE part_id = {p}", f"p{t + 1}"))
                t += 1
            head = head.replace(f", g{r} AS MATERIALIZED ({{g{r}}})", "")
        else:
            parts = f"(SELECT count(DISTINCT part_id) FROM rows WHERE group_id = {r})"
            part = f"SELECT vec_id, label, x0, 1e0 / (group_batches * {parts}) AS w FROM rows WHERE group_id = {r}"
            steps.append((f"p{t}", softmax_gradient(f"p{t}", part), f"p{t + 1}"))
            t += 1
        errors.append((r + 1, softmax_error(f"p{t}", CLASS_ROWS)))
    return softmax_training("", steps, errors, head)


def stream_train_sql() -> str:
    head = f"rows AS ({CLASS_ROWS})"
    steps = []
    for t in range(3):
        part = f"SELECT vec_id, label, x0, 1e0 AS w FROM rows WHERE vec_id % 3 = {t}"
        steps.append((f"p{t}", softmax_gradient(f"p{t}", part), f"p{t + 1}"))
    final = f"SELECT layer, name, idx, {rounded('value')} AS value, {rounded('m')} AS m, {rounded('v')} AS v, CAST(3 AS BIGINT) AS step FROM {{last}}"
    return softmax_training("", steps, [], head, final)


# ---- single statements --------------------------------------------------------------------------


def listed(column: str, names: list[str], offset: int = 0) -> str:
    return ", ".join(f"{column}[{offset + i + 1}]::DOUBLE AS {n}" for i, n in enumerate(names))


def scores_sql(widths: list[int]) -> str:
    ctes, name = forward(CLASS_ROWS, widths)
    return f"WITH {ctes} SELECT vec_id, CAST(c AS INTEGER) AS c, {rounded('x2[c + 1]')} AS score FROM {name}, range({widths[-1]}) AS t(c)"


def with_scores(select: str) -> str:
    ctes, name = forward(CLASS_ROWS, [64, 16, 10])
    return f"WITH {ctes}, scored AS (SELECT vec_id, label, x2 AS s, list_position(x2, list_max(x2)) - 1 AS predicted FROM {name}) {select}"


def mse_sql() -> str:
    ctes, name = forward(FLAG_ROWS, [4, 8, 1], 1000.0)
    return f"WITH {ctes} SELECT count(*) AS n, {rounded('avg((x2[1] - target[1]) * (x2[1] - target[1]))')} AS mse FROM {name}"


def part_errors(select: str) -> str:
    ctes, name = forward(batched_rows(CLASS_ROWS, 4, 50), [64, 16, 10])
    return f"""WITH {ctes}, judged AS (SELECT part_id, batch_id, CASE WHEN list_position(x2, list_max(x2)) - 1 = label THEN 0e0 ELSE 1e0 END AS wrong FROM {name}),
      parts AS (SELECT part_id, avg(wrong) AS error FROM judged GROUP BY part_id),
      firsts AS (SELECT part_id, avg(wrong) AS error FROM judged WHERE batch_id = 0 GROUP BY part_id) {select}"""


def conv_tap(c_in: int) -> str:
    return f"((dy + 2) * 5 + dx + 2) * {c_in} + ch"


def conv_forward_ctes() -> str:
    """Convolution and pooling as joins on coordinates; 8 x 8 -> 4 x 4 x 2 -> 2 x 2 x 3 -> 8 -> 10.

    ``pos`` remembers where the largest value of each pooling window was.
    """

    def stage(layer: int, side: int, c_in: int, c_out: int) -> str:
        return f"""z{layer} AS (
          SELECT vec_id, oy, ox, o, greatest(0e0, sum(v * {weight(layer, conv_tap(c_in), 'o')}) + any_value({bias(layer, 'o')})) AS z
          FROM (SELECT p.vec_id, p.ch, p.v, dy, dx, o, p.y - dy AS oy, p.x - dx AS ox
                FROM px{layer} p, range(-2, 3) AS ty(dy), range(-2, 3) AS tx(dx), range({c_out}) AS tc(o))
          WHERE oy BETWEEN 0 AND {side - 1} AND ox BETWEEN 0 AND {side - 1} GROUP BY vec_id, oy, ox, o),
        px{layer + 1} AS (SELECT vec_id, oy // 2 AS y, ox // 2 AS x, o AS ch, max(z) AS v, arg_max(oy * 8 + ox, z) AS pos FROM z{layer} GROUP BY vec_id, oy // 2, ox // 2, o)"""

    dense = f"""flat AS (SELECT vec_id, list(v ORDER BY (y * 2 + x) * 3 + ch) AS f FROM px2 GROUP BY vec_id),
      hidden AS (SELECT vec_id, f, list_transform(range(8), lambda j: greatest(0e0, list_sum(list_transform(range(12), lambda i: f[i + 1] * {weight(2, 'i', 'j')})) + {bias(2, 'j')})) AS h FROM flat),
      scored AS (SELECT vec_id, f, h, list_transform(range(10), lambda j: list_sum(list_transform(range(8), lambda i: h[i + 1] * {weight(3, 'i', 'j')})) + {bias(3, 'j')}) AS s FROM hidden)"""
    pixels = "px0 AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, 0 AS ch, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS t(i))"
    return f"{pixels}, {stage(0, 8, 1, 2)}, {stage(1, 4, 2, 3)}, {dense}"


def conv_sql() -> str:
    return f"WITH {conv_forward_ctes()} SELECT vec_id, CAST(c AS INTEGER) AS c, {rounded('s[c + 1]')} AS score FROM scored, range(10) AS t(c)"


def conv_gradient_sql() -> str:
    """The way back: deltas of a pooled value go to ``pos``, those of an input to every window it was in."""

    def filters(layer: int, c_in: int, c_out: int) -> str:
        return f"""SELECT {layer} AS layer, 'W' AS name, CAST(({conv_tap(c_in)}) * {c_out} + o AS INTEGER) AS idx, sum(e.d * p.v) AS g
          FROM (SELECT *, oy + dy AS y, ox + dx AS x FROM dz{layer}, range(-2, 3) AS ty(dy), range(-2, 3) AS tx(dx)) e
          JOIN px{layer} p USING (vec_id, y, x) GROUP BY dy, dx, ch, o
        UNION ALL SELECT {layer}, 'b', CAST(o AS INTEGER), sum(d) FROM dz{layer} GROUP BY o"""

    def dense(layer: int, x: str, d: str, n_in: int, n_out: int) -> str:
        return f"""SELECT {layer}, 'W', CAST(i * {n_out} + j AS INTEGER), sum({x}[i + 1] * {d}[j + 1]) FROM back, range({n_in}) AS ti(i), range({n_out}) AS tj(j) GROUP BY i, j
        UNION ALL SELECT {layer}, 'b', CAST(j AS INTEGER), sum({d}[j + 1]) FROM back, range({n_out}) AS tj(j) GROUP BY j"""

    return f"""WITH {conv_forward_ctes()},
      b3 AS (SELECT vec_id, f, h, {SOFTMAX_DELTA.format(s='s')} AS ds FROM scored JOIN embeddings USING (vec_id)),
      b2 AS (SELECT *, list_transform(range(8), lambda j: CASE WHEN h[j + 1] > 0 THEN list_sum(list_transform(range(10), lambda c: {weight(3, 'j', 'c')} * ds[c + 1])) ELSE 0e0 END) AS dh FROM b3),
      back AS (SELECT *, list_transform(range(12), lambda i: list_sum(list_transform(range(8), lambda j: {weight(2, 'i', 'j')} * dh[j + 1]))) AS df FROM b2),
      dz1 AS (SELECT vec_id, pos // 8 AS oy, pos % 8 AS ox, ch AS o, df[(y * 2 + x) * 3 + ch + 1] AS d FROM px2 JOIN back USING (vec_id) WHERE v > 0),
      dpx1 AS (SELECT vec_id, oy + dy AS y, ox + dx AS x, ch, sum(d * {weight(1, conv_tap(2), 'o')}) AS d
        FROM dz1, range(-2, 3) AS ty(dy), range(-2, 3) AS tx(dx), range(2) AS tc(ch) GROUP BY vec_id, oy + dy, ox + dx, ch),
      dz0 AS (SELECT vec_id, pos // 8 AS oy, pos % 8 AS ox, ch AS o, d FROM px1 JOIN dpx1 USING (vec_id, y, x, ch) WHERE v > 0),
      sizes AS (SELECT * FROM (VALUES (0, 'W', 50), (0, 'b', 2), (1, 'W', 150), (1, 'b', 3), (2, 'W', 96), (2, 'b', 8), (3, 'W', 80), (3, 'b', 10)) t(layer, name, n)),
      places AS (SELECT layer, name, CAST(unnest(range(n)) AS INTEGER) AS idx FROM sizes)
      SELECT layer, name, idx, {rounded('coalesce(g, 0e0)')} AS g FROM places LEFT JOIN (
        {filters(0, 1, 2)} UNION ALL {filters(1, 2, 3)} UNION ALL {dense(2, 'f', 'dh', 12, 8)} UNION ALL {dense(3, 'h', 'ds', 8, 10)}) USING (layer, name, idx)"""


def batch_gradient_sql(loss: str) -> str:
    rows, widths = (CLASS_ROWS, [64, 16, 10]) if loss == "xent" else (TARGET_ROWS, [49, 8, 15])
    ctes, name = backward(batched_rows(rows, 4, 50), widths, loss)
    weighted = "1e0" if loss == "xent" else "1e0 / (batch_rows * 15)"
    return f"WITH {ctes} SELECT part_id, batch_id, layer, name, idx, {rounded('g')} AS g FROM ({gradient(name, widths, ['part_id', 'batch_id'], weighted)})"


def group_gradient_sql() -> str:
    widths = [64, 16, 10]
    ctes, name = backward(batched_rows(CLASS_ROWS, 3, 25, 3), widths, "xent")
    grads = gradient(name, widths, ["part_id", "group_id"], "1e0 / group_batches")
    return f"WITH {ctes} SELECT part_id, group_id, layer, name, idx, {rounded('g')} AS g FROM ({grads})"


def line_gradient_sql() -> str:
    ctes, name = backward(THOUSAND_ROWS, [4, 8, 1], "mse")
    return f"WITH {ctes} SELECT layer, name, idx, {rounded('g', 2)} AS g FROM ({gradient(name, [4, 8, 1], [], '1e0')})"


def line_updates_sql(steps: int) -> str:
    ctes, name = backward(f"SELECT *, 1e0 / count(*) OVER (PARTITION BY part_id) AS w FROM ({THOUSAND_ROWS})", [4, 8, 1], "mse")
    return three_updates("momentum", "1e-4", ctes, gradient(name, [4, 8, 1], ["part_id"], "w"), [4, 8, 1], {"accum": "0e0"}, steps)


def adam_sql() -> str:
    widths = [64, 16, 10]
    ctes, name = backward(batched_rows(CLASS_ROWS, 3, 0), widths, "xent")
    return three_updates("adam", "0.01e0", ctes, gradient(name, widths, ["part_id"], "1e0"), widths, {"m": "0e0", "v": "0e0"})


def rmsprop_sql() -> str:
    widths = [49, 8, 15]
    ctes, name = backward(batched_rows(TARGET_ROWS, 3, 0), widths, "mse")
    return three_updates("rmsprop", "0.01e0", ctes, gradient(name, widths, ["part_id"], "1e0 / (batch_rows * 15)"), widths, {"ms": "1e0"})


def log_sql() -> str:
    """Every accepted message in order of arrival, folded one by one over a list."""
    step = """{'g': x.g, 'm': 0.9e0 * a.m + 0.1e0 * x.g, 'v': 0.999e0 * a.v + 0.001e0 * x.g * x.g, 't': a.t + 1,
      'p': a.p - 0.001e0 * sqrt(1 - pow(0.999e0, a.t + 1)) / (1 - pow(0.9e0, a.t + 1)) * (0.9e0 * a.m + 0.1e0 * x.g)
        / (sqrt(0.999e0 * a.v + 0.001e0 * x.g * x.g) + 1e-8)}"""
    items = "list({'g': value * k, 'm': 0e0, 'v': 0e0, 't': 0e0, 'p': 0e0} ORDER BY arrived, event_id)"
    return f"""WITH factors AS (SELECT * FROM (VALUES ('W', 0, 0.01e0), ('W', 1, 0.02e0), ('W', 2, 0.03e0), ('b', 0, 0.04e0)) f(name, idx, k)),
      log AS (SELECT event_id, value, {ARRIVED} AS arrived FROM events WHERE {AGE} < 100000000),
      start AS ({start_values([3, 1], {})}),
      lists AS (SELECT name, idx, {items} AS msgs FROM log, factors GROUP BY name, idx),
      folded AS (SELECT s.layer, s.name, s.idx, list_reduce(list_prepend({{'g': 0e0, 'm': 0e0, 'v': 0e0, 't': 0e0, 'p': s.value}}, l.msgs), lambda a, x: {step}) AS e
        FROM lists l JOIN start s ON s.name = l.name AND s.idx = l.idx)
      SELECT layer, name, idx, {rounded('e.p')} AS value, {rounded('e.m')} AS m, {rounded('e.v')} AS v, CAST(e.t AS BIGINT) AS step,
        (SELECT count(*) FROM events) AS received, (SELECT count(*) FROM events WHERE {AGE} >= 100000000) AS rejected FROM folded"""


def uniforms_sql(source: str, key: str, salt: int, counter: str) -> str:
    """``source`` with ``u``, the draw of ``key`` and ``counter`` in 64-bit arithmetic."""
    whole = 1 << 64

    def times(x: str, factor) -> str:
        return f"CAST((CAST({x} AS UHUGEINT) * {int(factor)}::UHUGEINT) % {whole}::UHUGEINT AS UBIGINT)"

    moved = salt * int(draws.KEY_STEP) % whole
    out = f"SELECT *, xor(CAST((CAST({key} AS UHUGEINT) + {moved}::UHUGEINT) % {whole}::UHUGEINT AS UBIGINT), {times(counter, draws.COUNTER_STEP)}) AS h_ FROM {source}"
    for shift, factor in draws.ROUNDS:
        out = f"SELECT * REPLACE ({times(f'xor(h_, h_ >> {shift}::UBIGINT)', factor)} AS h_) FROM ({out})"
    return f"SELECT * EXCLUDE (h_), CAST(xor(h_, h_ >> {draws.LAST_SHIFT}::UBIGINT) >> 11::UBIGINT AS DOUBLE) / {float(1 << 53)!r} AS u FROM ({out})"


def masks_sql(units: int, salt: int, seed: int = SEED) -> str:
    """``(vec_id, mask)``: which hidden units of every row are kept, with a half of them, and how much they count."""
    drawn = uniforms_sql(f"(SELECT vec_id, {hashed('vec_id', seed)} AS h, unit FROM embeddings, range({units}) AS t(unit))", "h", salt, "unit + 1")
    return f"SELECT vec_id, list(CASE WHEN u < 0.5e0 THEN 2e0 ELSE 0e0 END ORDER BY unit) AS mask FROM ({drawn}) GROUP BY vec_id"


def normal_quantile_sql(p: str) -> str:
    def ratio(coefficients, x: str) -> str:
        def value(c) -> str:
            out = f"{c[-1]!r}"
            for a in c[-2::-1]:
                out = f"({out} * {x} + {a!r})"
            return out

        return f"({value(coefficients[0])} / {value(coefficients[1])})"

    q = f"({p} - 0.5e0)"
    centre = f"{q} * {ratio(draws.CENTRE, f'({draws.CENTRE_SQUARE!r} - {q} * {q})')}"
    tail = f"sign({q}) * {ratio(draws.TAIL, f'(sqrt(-ln(least({p}, 1 - {p}))) - {draws.TAIL_FROM!r})')}"
    return f"CASE WHEN abs({q}) <= {draws.CENTRE_HALF!r} THEN {centre} ELSE {tail} END"


WIDE = "(SELECT CAST(i AS BIGINT) AS idx, n FROM (SELECT count(*) AS n FROM embeddings), range((SELECT 16 * count(*) FROM embeddings)) AS t(i))"


def init_sql(value: str) -> str:
    return f"SELECT idx, {rounded(value)} AS value FROM ({uniforms_sql(WIDE, '0', SEED, 'idx + 1')})"


def dropout_gradient_sql() -> str:
    widths = [64, 16, 10]
    rows = f"SELECT * FROM ({batched_rows(CLASS_ROWS, 4, 50)}) JOIN ({masks_sql(16, 3)}) USING (vec_id)"
    ctes, name = backward(rows, widths, "xent", masked=True)
    return f"WITH {ctes} SELECT part_id, batch_id, layer, name, idx, {rounded('g')} AS g FROM ({gradient(name, widths, ['part_id', 'batch_id'], '1e0')})"


# places in the packed list of a 64-16-10 network: weights and biases of the hidden stage, then of the last
# W0 from 0, b0 from 1024, W1 from 1040, b1 from 1200 to 1210
def deep_hidden(p: str) -> str:
    return f"list_transform(range(16), lambda j: greatest(0e0, list_sum(list_transform(range(64), lambda i: x0[i + 1] * {p}[i * 16 + j + 1])) + {p}[1024 + j + 1]))"


def deep_scores(p: str, x: str) -> str:
    return f"list_transform(range(10), lambda c: list_sum(list_transform(range(16), lambda h: {x}[h + 1] * {p}[1040 + h * 10 + c + 1])) + {p}[1200 + c + 1])"


def deep_rounds_sql() -> str:
    """Three rounds of a network with a hidden stage and dropout, unrolled; the mask is off when measuring."""
    largest = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY ({hashed('vec_id', SEED)}) % 4))"
    start = f"""SELECT list(value ORDER BY layer, name, idx) AS p FROM ({start_values([64, 16, 10], {})})"""
    ctes = [
        f"rows AS MATERIALIZED (SELECT * FROM ({batched_rows(CLASS_ROWS, 4, f'(({largest} + 5) // 6)', 2)}) JOIN ({masks_sql(16, 5)}) USING (vec_id))",
        f"q0 AS MATERIALIZED (SELECT p, list_transform(p, lambda x: 0e0) AS m, list_transform(p, lambda x: 0e0) AS v FROM ({start}))",
    ]
    errors = []
    for r in range(3):
        parts = f"(SELECT count(DISTINCT part_id) FROM rows WHERE group_id = {r})"
        ctes.append(
            f"""d{r} AS MATERIALIZED (SELECT *, list_transform(range(16), lambda h: CASE WHEN x1[h + 1] > 0 THEN mask[h + 1] * list_sum(list_transform(range(10), lambda c: p[1040 + h * 10 + c + 1] * d2[c + 1])) ELSE 0e0 END) AS d1 FROM (
            SELECT *, {SOFTMAX_DELTA.format(s='s')} AS d2 FROM (SELECT *, {deep_scores('p', 'x1')} AS s FROM (
            SELECT label, x0, mask, p, 1e0 / (group_batches * {parts}) AS w, list_transform(range(16), lambda j: mask[j + 1] * {deep_hidden('p')}[j + 1]) AS x1 FROM rows, q{r} WHERE group_id = {r}))))"""
        )
        ctes.append(
            f"""g{r} AS MATERIALIZED (SELECT list(g ORDER BY k) AS g FROM (
            SELECT i * 16 + j AS k, sum(w * x0[i + 1] * d1[j + 1]) AS g FROM d{r}, range(64) AS ti(i), range(16) AS tj(j) GROUP BY i, j
            UNION ALL SELECT 1024 + j, sum(w * d1[j + 1]) FROM d{r}, range(16) AS tj(j) GROUP BY j
            UNION ALL SELECT 1040 + h * 10 + c, sum(w * x1[h + 1] * d2[c + 1]) FROM d{r}, range(16) AS th(h), range(10) AS tc(c) GROUP BY h, c
            UNION ALL SELECT 1200 + c, sum(w * d2[c + 1]) FROM d{r}, range(10) AS tc(c) GROUP BY c))"""
        )
        ctes.append(f"q{r + 1} AS MATERIALIZED (SELECT {packed_adam('p', 'm', 'v', 'g', str(r + 1), 1210, '0.01e0')} FROM q{r}, g{r})")
        scored = f"SELECT label, {deep_scores('p', 'x1')} AS s FROM (SELECT label, p, {deep_hidden('p')} AS x1 FROM rows, q{r + 1})"
        errors.append(f"UNION ALL SELECT 'error', {r + 1}, {rounded('1 - avg(CASE WHEN list_position(s, list_max(s)) - 1 = label THEN 1e0 ELSE 0e0 END)')} FROM ({scored})")
    places = " ".join(f"WHEN i < {end} THEN '{name}'" for name, end in (("W0", 1024), ("b0", 1040), ("W1", 1200), ("b1", 1210)))
    first = " ".join(f"WHEN i < {end} THEN i - {begin}" for begin, end in ((0, 1024), (1024, 1040), (1040, 1200), (1200, 1210)))
    return f"""WITH {', '.join(ctes)} SELECT CASE {places} END AS item, CAST(CASE {first} END AS INTEGER) AS idx, {rounded('p[i + 1]')} AS value FROM q3, range(1210) AS t(i)
      {' '.join(errors)}"""


def packed_start() -> str:
    """The start of the softmax regression as one list: weights, then biases."""
    return f"SELECT list(value ORDER BY name, idx) AS p FROM ({start_values([64, 10], {})})"


def packed_scores(p: str, x: str = "x0") -> str:
    """Scores of a row from a packed list of parameters."""
    return f"list_transform(range(10), lambda c: list_sum(list_transform(range(64), lambda i: {x}[i + 1] * {p}[i * 10 + c + 1])) + {p}[640 + c + 1])"


def packed_adam(p: str, m: str, v: str, g: str, t: str, n: int = 650, lr: str = "0.05e0") -> str:
    """One update of packed parameters and slots, as ``{{'p', 'm', 'v'}}`` lists out of three lists and a gradient."""
    new_m = f"list_transform(range({n}), lambda i: 0.9e0 * {m}[i + 1] + 0.1e0 * {g}[i + 1])"
    new_v = f"list_transform(range({n}), lambda i: 0.999e0 * {v}[i + 1] + 0.001e0 * {g}[i + 1] * {g}[i + 1])"
    rate = f"{lr} * sqrt(1 - pow(0.999e0, {t})) / (1 - pow(0.9e0, {t}))"
    return f"""list_transform(range({n}), lambda i: {p}[i + 1] - {rate} * (0.9e0 * {m}[i + 1] + 0.1e0 * {g}[i + 1])
      / (sqrt(0.999e0 * {v}[i + 1] + 0.001e0 * {g}[i + 1] * {g}[i + 1]) + 1e-8)) AS p, {new_m} AS m, {new_v} AS v"""


def packed_error(states: str, rows: str) -> str:
    """``(mark, e)``: the share of wrong classes of each of the packed states ``(mark, p)``."""
    return f"""SELECT mark, 1 - avg(CASE WHEN list_position(s, list_max(s)) - 1 = label THEN 1e0 ELSE 0e0 END) AS e
      FROM (SELECT mark, label, {packed_scores('p')} AS s FROM {states}, ({rows})) GROUP BY mark"""


def stream_apply_sql() -> str:
    """Messages folded one by one in order of arrival; errors wherever a tenth message was accepted."""
    rows = f"SELECT vec_id, label, x0, 1e0 AS w, vec_id // 5 AS message FROM ({CLASS_ROWS})"
    return f"""WITH RECURSIVE p0 AS ({start_values([64, 10], {'m': '0e0', 'v': '0e0'})}),
      flat AS MATERIALIZED ({softmax_gradient('p0', rows, 'message')}),
      pushed AS MATERIALIZED (SELECT message, list(g ORDER BY name, idx) AS g FROM flat GROUP BY message),
      log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY accepted ORDER BY received) AS seq FROM (
        SELECT g, {AGE} < 100000000 AS accepted, row_number() OVER (ORDER BY {ARRIVED}, event_id) AS received FROM pushed JOIN events ON event_id = message)),
      run AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS received, p, list_transform(p, lambda x: 0e0) AS m, list_transform(p, lambda x: 0e0) AS v FROM ({packed_start()})
        UNION ALL SELECT l.seq, l.received, {packed_adam('r.p', 'r.m', 'r.v', 'l.g', 'l.seq')} FROM run r JOIN log l ON l.accepted AND l.seq = r.seq + 1),
      states AS MATERIALIZED (SELECT seq, received AS mark, p FROM run),
      points AS (SELECT mark, p FROM states WHERE seq > 0 AND mark % 10 = 0),
      last AS (SELECT p FROM states ORDER BY seq DESC LIMIT 1)
      SELECT CASE WHEN i < 640 THEN 'W' ELSE 'b' END AS item, CASE WHEN i < 640 THEN i ELSE i - 640 END AS idx, {rounded('p[i + 1]')} AS value FROM last, range(650) AS t(i)
      UNION ALL SELECT 'error', mark, {rounded('e')} FROM ({packed_error('points', CLASS_ROWS)})"""


def held_sql(log: str, lag_us: int = 100000000) -> str:
    """``(message, received, accepted, seq, version)`` of a log ``(message, pulled, sent, arrived)``."""
    return f"""SELECT l.*, CASE WHEN l.accepted THEN least(seq - 1, (SELECT count(*) FROM judged b WHERE b.accepted AND b.arrived <= j.pulled)) END AS version
      FROM (SELECT message, received, accepted, CASE WHEN accepted THEN row_number() OVER (PARTITION BY accepted ORDER BY received) END AS seq FROM judged) l JOIN judged j USING (message)""", (
        f"judged AS MATERIALIZED (SELECT *, epoch_us(arrived) - epoch_us(sent) < {lag_us} AS accepted, row_number() OVER (ORDER BY arrived, message) AS received FROM ({log}))"
    )


def held_versions_sql() -> str:
    select, judged = held_sql(f"SELECT event_id AS message, ts - INTERVAL 20 MINUTE AS pulled, ts AS sent, {ARRIVED} AS arrived FROM events")
    return f"WITH {judged} SELECT message, received, accepted, coalesce(seq, -1) AS seq, coalesce(version, -1) AS version FROM ({select})"


def train_stale_sql() -> str:
    """The replay as one recursion over the accepted messages that carries every version so far."""
    log = """SELECT message, pulled, sent, sent + to_seconds(message * 7 % 13 * 10) AS arrived FROM (
      SELECT message, pulled, pulled + to_seconds(60 + message * 37 % 23) AS sent FROM (
      SELECT DISTINCT vec_id // 20 AS message, TIMESTAMP '2024-01-01' + to_seconds(vec_id // 20 // 8 * 100 + vec_id // 20 % 8 * 7) AS pulled FROM embeddings))"""
    select, judged = held_sql(log)
    held = "r.versions[l.version + 1]"
    delta = f"""list_transform(l.xs, lambda x: list_transform(list_value({packed_scores(held, 'x.x')}), lambda s: list_transform(range(10), lambda c:
      exp(s[c + 1] - list_max(s)) / list_sum(list_transform(s, lambda z: exp(z - list_max(s)))) - CASE WHEN c = x.label THEN 1e0 ELSE 0e0 END))[1])"""
    g = """list_transform(range(650), lambda i: 0.5e0 * list_sum(list_transform(range(len(d)), lambda k: CASE WHEN i < 640 THEN xs[k + 1].x[i // 10 + 1] * d[k + 1][i % 10 + 1] ELSE d[k + 1][i - 639] END)))"""
    return f"""WITH RECURSIVE {judged}, held AS ({select}),
      xs AS (SELECT vec_id // 20 AS message, list({{'x': x0, 'label': label}} ORDER BY vec_id) AS xs FROM ({CLASS_ROWS}) GROUP BY 1),
      log AS MATERIALIZED (SELECT h.*, xs FROM held h JOIN xs USING (message) WHERE accepted),
      run AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS received, p, list_transform(p, lambda x: 0e0) AS m, list_transform(p, lambda x: 0e0) AS v, [p] AS versions FROM ({packed_start()})
        UNION ALL SELECT seq, received, p, m, v, list_append(versions, p) FROM (
          SELECT seq, received, versions, {packed_adam('p', 'm', 'v', 'g', 'seq')} FROM (
            SELECT seq, received, versions, p, m, v, {g} AS g FROM (
              SELECT l.seq, l.received, l.xs, r.versions, r.p, r.m, r.v, {delta} AS d FROM run r JOIN log l ON l.seq = r.seq + 1)))),
      points AS MATERIALIZED (SELECT received AS mark, p FROM run WHERE seq > 0 AND received % 10 = 0),
      last AS (SELECT p FROM run ORDER BY seq DESC LIMIT 1)
      SELECT CASE WHEN i < 640 THEN 'W' ELSE 'b' END AS item, CAST(CASE WHEN i < 640 THEN i ELSE i - 640 END AS INTEGER) AS idx, {rounded('p[i + 1]')} AS value FROM last, range(650) AS t(i)
      UNION ALL SELECT 'error', CAST(mark AS INTEGER), {rounded('e')} FROM ({packed_error('points', CLASS_ROWS)})
      UNION ALL SELECT 'received', 0, CAST(count(*) AS DOUBLE) FROM judged
      UNION ALL SELECT 'rejected', 0, CAST(count(*) FILTER (NOT accepted) AS DOUBLE) FROM judged"""


EVENT_BATCHES = batches("events", "event_id", 8, 50)
SLICES = "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS r FROM (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 2000)"
BAD_LINE = """CASE WHEN vec_id % 10 = 0 THEN 'blank' WHEN vec_id % 17 = 0 THEN 'label_range'
  WHEN vec_id % 23 = 0 THEN 'short' WHEN vec_id % 29 = 0 THEN 'malformed' ELSE 'kept' END"""
ONE_HOT = ", ".join(f"CASE WHEN label = {i} THEN 1 ELSE 0 END AS c{i}" for i in range(10))


def _epoch(epoch: int) -> str:
    slices = "(SELECT greatest(2, (count(*) + 31999999) // 32000000) FROM events)"
    return f"""SELECT {epoch} AS epoch, event_id, CAST(h % 32 AS INTEGER) AS part_id, CAST(h % 32 * {slices} + h // 32 % {slices} AS INTEGER) AS task_id
      FROM (SELECT event_id, {hashed('event_id', SEED + epoch)} AS h FROM events)"""


ORACLES = {
    "parse_class_first": f"SELECT label, {listed('embedding', [f'x{i}' for i in range(64)])} FROM embeddings",
    "parse_target_last": """SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
      CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS target FROM lineitem""",
    "parse_multi_target": f"""SELECT {listed('embedding', [f'x{i}' for i in range(49)])},
      {listed('embedding', [f'y{i}' for i in range(15)], 49)} FROM embeddings""",
    "scan_line_numbers": "SELECT count(*) AS n_lines, true AS all_numbered, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events",
    "one_hot_label": f"SELECT vec_id, {ONE_HOT} FROM embeddings",
    "features_to_float": "SELECT vec_id, CAST(i AS INTEGER) AS pos, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) AS t(i)",
    "drop_bad_lines": f"SELECT reason, count(*) AS n FROM (SELECT {BAD_LINE} AS reason FROM embeddings) GROUP BY reason",
    "limited_take": "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 2500",
    "warmup_holdout": """SELECT event_id, user_id, value FROM events
      WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id LIMIT 2000)""",
    "assign_minibatch": EVENT_BATCHES,
    "assign_minibatch_all": f"SELECT event_id, part_id, batch_id, batch_rows FROM ({batches('events', 'event_id', 8, 0)})",
    "assign_minibatch_fast_hash": "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(8 AS BIGINT) AS n_parts, true AS all_right FROM events",
    "push_groups": f"""SELECT part_id, group_id, count(*) AS n_rows, min(batch_id) AS first_batch, max(batch_id) AS last_batch,
      CAST(count(DISTINCT batch_id) AS INTEGER) AS n_batches, count(DISTINCT batch_id) = 5 AS complete FROM ({EVENT_BATCHES}) GROUP BY part_id, group_id""",
    "warmup_slices": f"""SELECT event_id, CAST((row_number() OVER (ORDER BY r) - 1) // 50 AS INTEGER) AS slice_id
      FROM ({SLICES}) WHERE event_type <> 'error'""",
    "warmup_slices_count_skipped": f"SELECT event_id, CAST(r // 50 AS INTEGER) AS slice_id FROM ({SLICES}) WHERE event_type <> 'error'",
    "epoch_repartition": f"{_epoch(0)} UNION ALL {_epoch(1)}",
    "dense_forward": scores_sql([64, 16, 10]),
    "conv_forward": conv_sql(),
    "predict_argmax": with_scores("SELECT vec_id, CAST(predicted AS INTEGER) AS predicted FROM scored"),
    "error_rate": with_scores(f"SELECT count(*) AS n, {rounded('1 - avg(CASE WHEN predicted = label THEN 1e0 ELSE 0e0 END)')} AS error FROM scored"),
    "accuracy": with_scores(f"SELECT {rounded('avg(CASE WHEN predicted = label THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM scored"),
    "softmax_xent": with_scores(
        f"SELECT vec_id, {rounded('ln(list_sum(list_transform(s, lambda v: exp(v - list_max(s))))) + list_max(s) - s[label + 1]')} AS xent FROM scored"
    ),
    "mse_loss": mse_sql(),
    "partition_eval": part_errors(
        f"""SELECT 'part' AS scope, part_id, {rounded('error')} AS error FROM parts
        UNION ALL SELECT 'weighted', -1, {rounded('avg(wrong)')} FROM judged
        UNION ALL SELECT 'unweighted', -1, {rounded('avg(error)')} FROM parts
        UNION ALL SELECT 'first_batch_unweighted', -1, {rounded('avg(error)')} FROM firsts"""
    ),
    "batch_gradient_xent": batch_gradient_sql("xent"),
    "batch_gradient_mse": batch_gradient_sql("mse"),
    "batch_gradient_dropout": dropout_gradient_sql(),
    "conv_gradient": conv_gradient_sql(),
    "gradient_sum": line_gradient_sql(),
    "gradient_mean": group_gradient_sql(),
    "adam_update": adam_sql(),
    "momentum_update": line_updates_sql(3),
    "rmsprop_update": rmsprop_sql(),
    "params_roundtrip": line_updates_sql(1),
    "warmup_curve": warmup_sql(),
    "train_rounds": rounds_sql(sequential=False),
    "train_rounds_sequential": rounds_sql(sequential=True),
    "train_rounds_deep": deep_rounds_sql(),
    "init_truncated_normal": init_sql(f"0.1e0 * {normal_quantile_sql(f'({draws.BELOW_TWO!r} + u * {1 - 2 * draws.BELOW_TWO!r})')}"),
    "init_constant": init_sql("0.1e0"),
    "init_xavier_uniform": init_sql("(2 * u - 1) * sqrt(6e0 / (n + 16))"),
    "train_stale": train_stale_sql(),
    "held_versions": held_versions_sql(),
    "training_log_roundtrip": part_errors(
        f"""SELECT 'all_rows' AS run_id, 'eval' AS phase, CAST(part_id AS BIGINT) AS step, {rounded('error')} AS error FROM parts
        UNION ALL SELECT 'first_batch', 'eval', CAST(part_id AS BIGINT), {rounded('error')} FROM firsts"""
    ),
    "stale_reject": f"SELECT event_id AS id, {AGE} AS age_us, {AGE} < 100000000 AS accepted FROM events",
    "gradient_counts": f"SELECT count(*) AS received, count(*) FILTER ({AGE} >= 100000000) AS rejected FROM events",
    "eval_cadence": f"""SELECT received, id FROM (SELECT event_id AS id, {AGE} < 100000000 AS accepted,
      row_number() OVER (ORDER BY {ARRIVED}, event_id) AS received FROM events) WHERE received % 10 = 0 AND accepted""",
    "stream_stale_reject": f"SELECT {AGE} < 100000000 AS accepted, count(*) AS n FROM events GROUP BY 1",
    "stream_worker_cadence": """SELECT user_id AS worker, count(*) AS iterations, (count(*) + 4) // 5 AS pulls, count(*) // 5 AS pushes
      FROM events GROUP BY user_id""",
    "stream_apply": stream_apply_sql(),
    "stream_apply_log": log_sql(),
    "stream_train": stream_train_sql(),
}
