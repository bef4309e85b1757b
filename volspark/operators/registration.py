"""Registration of volumes and construction of atlases.

A pair of volumes, or an image of an atlas with its deformation, is one row;
tasks work on stacks of rows. Atlas loops send the partial sums of the deformed
images to the mean, and the mean back to the images of its cohort; lineage is
cut each iteration. Levels of a pyramid go from coarse to fine, and each starts
from the deformation that the one before it found.

Velocities are in voxels a time step: each of the T steps of a path moves by v_t.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from volspark.config import FULL, AtlasParams, GreedyParams, LDMMParams, Level, OperatorParams
from volspark.operators import kernels
from volspark.operators.grid import Size
from volspark.operators.kernels import gradient, jacobian, sample, splat, warp
from volspark.operators.spectral import apply_operator
from volspark.plans.state import cut

#: Bytes of the means of all cohorts that are sent to every task; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _x(v: np.ndarray) -> np.ndarray:
    """The identity (1, 3, z, y, x) for a stack of images."""
    return kernels.identity(v.shape[:0:-1])[None]


def _k(field: np.ndarray, p: OperatorParams) -> np.ndarray:
    return apply_operator(field, field.shape[:1:-1], alpha=p.alpha, beta=p.beta, gamma=p.gamma, power=p.power, inverse=True, incompressible=p.incompressible)


def _l(field: np.ndarray, p: OperatorParams) -> np.ndarray:
    return apply_operator(field, field.shape[:1:-1], alpha=p.alpha, beta=p.beta, gamma=p.gamma, power=p.power)


def _sum(v: np.ndarray) -> np.ndarray:
    """Sums over all but the first axis."""
    return v.reshape(len(v), -1).sum(1)


def _most(field: np.ndarray) -> np.ndarray:
    """Length of the longest vector of each field."""
    return np.sqrt((field**2).sum(1)).reshape(len(field), -1).max(1)


def _each(a: np.ndarray) -> np.ndarray:
    """A number for each image, in the shape of a stack of fields."""
    return a[:, None, None, None, None]


def _then(h: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """h at the places ``moved``; beyond the grid h is a shift by nothing."""
    return sample(h - kernels.identity(h.shape[:1:-1]), moved) + moved


# Pyramids.


def level_size(size: Size, factor: int) -> Size:
    return tuple(max(n // factor, 1) for n in size)


def to_level(v: np.ndarray, factor: int) -> np.ndarray:
    """A stack of images, smoothed and decimated."""
    if factor == 1:
        return v
    sigma = float(np.sqrt(factor / 2))
    smooth = kernels.blur(v, [sigma] * 3, [2 * int(np.ceil(sigma))] * 3)
    n = level_size(v.shape[:0:-1], factor)
    return smooth[:, ::factor, ::factor, ::factor][:, : n[2], : n[1], : n[0]]


def _finer(field: np.ndarray, size: Size) -> np.ndarray:
    """A stack of displacements in a finer grid."""
    old = field.shape[:1:-1]
    return np.stack([kernels.resize(field[:, i], size) * ((size[i] - 1) / (old[i] - 1) if old[i] > 1 else 1.0) for i in range(3)], 1)


# Steps of the methods on stacks of images.


def greedy_step(moving: np.ndarray, fixed: np.ndarray, h: np.ndarray, delta: np.ndarray, p: GreedyParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, delta, energy): b = -(I0(h) - I1) grad I0(h), v = K b, h(x + delta v).

    Where delta is NaN, the step sets it so that no voxel moves by more than max_pert.
    """
    warped = warp(moving, h)
    v = _k(-(warped - fixed)[:, None] * gradient(warped), p.operator)
    top = _most(v)
    delta = np.where(np.isnan(delta), np.where(top > 0, p.max_pert / np.where(top > 0, top, 1), 0.0), delta)
    return _then(h, _x(moving) + _each(delta) * v), delta, _sum((warped - fixed) ** 2)


def greedy_register(moving: np.ndarray, fixed: np.ndarray, p: GreedyParams, levels: Sequence[Level] = FULL) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(h, [(factor, energy)]) over the levels."""
    h, log = None, []
    for level in levels:
        a, b = to_level(moving, level.factor), to_level(fixed, level.factor)
        h = np.repeat(_x(a), len(a), 0) if h is None else kernels.resize_places(h, a.shape[:0:-1])
        delta = np.full(len(a), np.nan)
        for _ in range(p.iterations if level.iterations is None else level.iterations):
            h, delta, e = greedy_step(a, b, h, delta, p)
            log.append((level.factor, e))
    return kernels.resize_places(h, moving.shape[:0:-1]), log


def shoot(image: np.ndarray, momentum: np.ndarray, p: LDMMParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(I_T, phi_T0, phi_0T, mean <Lv, v>) of the geodesic from an image and a scalar momentum.

    v_t = -K(alpha_t grad I_t); the momentum moves by splatting along phi_0t, and
    the image by pulling back along phi_t0.
    """
    x = _x(image)
    back, forth, energy = np.repeat(x, len(image), 0), np.repeat(x, len(image), 0), np.zeros(len(image))
    current, alpha = image, momentum
    for _ in range(p.time_steps):
        force = -alpha[:, None] * gradient(current)
        v = _k(force, p.operator)
        energy += _sum(force * v) / p.time_steps
        back = _then(back, x - v)
        forth = forth + sample(v, forth)
        current, alpha = warp(image, back), splat(momentum, forth)
    return current, back, forth, energy


def shooting_register(moving: np.ndarray, fixed: np.ndarray, p: LDMMParams, levels: Sequence[Level] = FULL) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(momentum, [(factor, energy)]): gradient steps on the initial momentum.

    A positive momentum brightens the image here, so the step follows what the
    end image lacks, splatted back to the start.
    """
    alpha, log = None, []
    for level in levels:
        a, b = to_level(moving, level.factor), to_level(fixed, level.factor)
        alpha = np.zeros_like(a) if alpha is None else kernels.resize(alpha, a.shape[:0:-1])
        step, last = np.full(len(a), p.step), None
        for _ in range(p.iterations if level.iterations is None else level.iterations):
            end, back, _, vec = shoot(a, alpha, p)
            total = _sum((end - b) ** 2) / p.sigma**2 + vec
            log.append((level.factor, total))
            if p.auto_reduce and last is not None:
                step = np.where(total > last, step / 2, step)
            last = total
            s = step[:, None, None, None]
            alpha = (1 - s) * alpha + (s / p.sigma**2) * splat(b - end, back)
    return alpha, log


def along(vs: np.ndarray) -> np.ndarray:
    """phi_T0 of velocities (B, T, 3, z, y, x)."""
    x = kernels.identity(vs.shape[:2:-1])[None]
    h = np.repeat(x, len(vs), 0)
    for t in range(vs.shape[1]):
        h = _then(h, x - vs[:, t])
    return h


def relax_step(moving: np.ndarray, fixed: np.ndarray, vs: np.ndarray, eps: np.ndarray, p: LDMMParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vs, eps, energy, the fixed image at time 0, the volume change there).

    v <- (1 - 2 eps) v + (2 eps / sigma^2) K(|D phi| (J0 - JT) grad J0). Where eps
    is NaN, it is set for all times from the largest step, so that no voxel moves
    by more than max_pert, and kept; a later step that would move one by more is
    shortened, for all times alike.
    """
    x, deformed = _x(moving), [moving]
    h = np.repeat(x, len(moving), 0)
    for t in range(p.time_steps):
        h = _then(h, x - vs[:, t])
        deformed.append(warp(moving, h))
    energy = _sum((deformed[-1] - fixed) ** 2) / p.sigma**2
    back, steps = np.repeat(x, len(moving), 0), np.zeros_like(vs)
    target, det = fixed, np.ones_like(fixed)
    for t in range(p.time_steps - 1, -1, -1):
        back = _then(back, x + vs[:, t])
        target, det = warp(fixed, back), jacobian(back)
        steps[:, t] = _k((det * (deformed[t] - target))[:, None] * gradient(deformed[t]), p.operator)
        energy = energy + _sum(_l(vs[:, t], p.operator) * vs[:, t]) / p.time_steps
    top = np.max([_most(steps[:, t]) for t in range(p.time_steps)], 0)
    own = np.where(top > 0, p.max_pert * p.sigma**2 / (2 * np.where(top > 0, top, 1)), p.step) if p.adaptive else np.full(len(vs), p.step)
    eps = np.where(np.isnan(eps), np.minimum(own, 0.5), eps)
    e = _each(np.minimum(eps, own) if p.adaptive else eps)[:, None]
    return (1 - 2 * e) * vs + (2 * e / p.sigma**2) * steps, eps, energy, target, det


def relax_register(moving: np.ndarray, fixed: np.ndarray, p: LDMMParams, levels: Sequence[Level] = FULL) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(velocities (B, T, 3, z, y, x), [(factor, energy)]): relaxation over velocities at all times."""
    vs, log = None, []
    for level in levels:
        a, b = to_level(moving, level.factor), to_level(fixed, level.factor)
        size = a.shape[:0:-1]
        vs = np.zeros((len(a), p.time_steps, 3, *size[::-1])) if vs is None else np.stack([_finer(vs[:, t], size) for t in range(p.time_steps)], 1)
        eps, last = np.full(len(a), np.nan), None
        for k in range(p.iterations if level.iterations is None else level.iterations):
            if p.reparameterise and k and k % p.reparameterise == 0:
                vs = reparameterise(vs)
            vs, eps, e, _, _ = relax_step(a, b, vs, eps, p)
            log.append((level.factor, e))
            if p.auto_reduce and last is not None:
                eps = np.where(e > last, eps / 2, eps)
            last = e
    return vs, log


def reparameterise(vs: np.ndarray) -> np.ndarray:
    """Velocities (B, T, ...) of constant speed along the same path, linear in cumulative length; a path without length stays."""
    steps = vs.shape[1]
    length = np.sqrt((vs**2).reshape(*vs.shape[:2], -1).sum(2))
    total = length.sum(1, keepdims=True)
    at = np.concatenate((np.zeros((len(vs), 1)), np.cumsum(length, 1)), 1) / np.where(total > 0, total, 1) * steps
    k = np.arange(steps)[None, :, None]
    shared = np.minimum(at[:, None, 1:], k + 1) - np.maximum(at[:, None, :-1], k)
    share = np.maximum(shared, 0) / np.maximum(at[:, None, 1:] - at[:, None, :-1], 1e-12)
    return np.where(total.reshape(-1, *[1] * (vs.ndim - 1)) > 0, np.einsum("bkj,bj...->bk...", share, vs), vs)


def affine_registers(moving: np.ndarray, fixed: np.ndarray, mode: str = "affine", iterations: int = 10, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matrices, shifts, rms (B, iterations), numbers of rms) of a stack of pairs by Gauss-Newton; a pair stops when its rms changes by less than tolerance.

    mode is affine, rigid (the matrix is brought to the nearest rotation after
    each step) or translation. Each pair has its own steps, as if it were alone.
    """
    b, shape = len(fixed), fixed.shape[1:]
    x = kernels.identity(shape[::-1]).reshape(3, -1)
    m, t = np.tile(np.eye(3), (b, 1, 1)), np.zeros((b, 3))
    log, count, on = np.zeros((b, iterations)), np.zeros(b, np.int64), np.arange(b)
    slopes = gradient(moving)
    for k in range(iterations):
        place = _affine_places(m[on], t[on], x, shape)
        residual = (fixed[on] - warp(moving[on], place, None)).reshape(len(on), -1)
        rms = log[on, k] = np.sqrt((residual**2).mean(1))
        count[on] = k + 1
        goes = np.isfinite(rms) & (rms != 0)
        if k:
            goes &= ~(np.abs(log[on, k - 1] - rms) < tolerance * log[on, k - 1])
        on, place, residual = on[goes], place[goes], residual[goes, :, None]
        if not len(on):
            break
        g = sample(slopes[on], place, "clamp").reshape(len(on), 3, -1)
        if mode == "translation":
            t[on] += _least_squares(g @ g.transpose(0, 2, 1) + 1e-9 * np.eye(3), (g @ residual)[..., 0])
            continue
        a = np.concatenate([(g[:, :, None] * x).reshape(len(on), 9, -1), g], 1)
        step = _least_squares(a @ a.transpose(0, 2, 1) + 1e-9 * np.eye(12), (a @ residual)[..., 0])
        moved, shift = m[on] + step[:, :9].reshape(-1, 3, 3), t[on] + step[:, 9:]
        if mode == "rigid":
            turned = nearest_rotation(moved)
            shift = shift + (moved - turned) @ x.mean(1)
            moved = turned
        m[on], t[on] = moved, shift
    return m, t, log, count


def affine_register(moving: np.ndarray, fixed: np.ndarray, mode: str = "affine", iterations: int = 10, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(matrix, shift, rms) of one pair by ``affine_registers``."""
    m, t, log, count = affine_registers(moving[None], fixed[None], mode, iterations, tolerance)
    return m[0], t[0], log[0, : count[0]].tolist()


def _affine_places(m: np.ndarray, t: np.ndarray, x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return (m @ x + t[:, :, None]).reshape(len(m), 3, *shape)


def _least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest least-squares solutions (B, n) of symmetric a (B, n, n); directions below rounding count as 0."""
    w, v = np.linalg.eigh(a)
    known = np.abs(w) > np.finfo(float).eps * a.shape[-1] * np.abs(w).max(-1, keepdims=True)
    along_v = (v.transpose(0, 2, 1) @ b[..., None])[..., 0]
    return (v @ np.where(known, along_v / np.where(known, w, 1), 0)[..., None])[..., 0]


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """U V' of the singular value decomposition, without a mirror; also of a stack."""
    u, _, vt = np.linalg.svd(m)
    mirror = np.sign(np.linalg.det(u @ vt))
    return u * np.stack([np.ones_like(mirror), np.ones_like(mirror), mirror], -1)[..., None, :] @ vt


# Registration of pairs.


def register(pairs: DataFrame, size: Size, method: str, params, levels: Sequence[Level] = FULL) -> DataFrame:
    """(pair_id, data, energy, scale): the moving image of each pair deformed to the fixed one, and the energy and the level of each iteration.

    method is greedy, shooting or relaxation, or affine, rigid or translation.
    """

    def run(s: kernels.Stacks) -> kernels.Stacks:
        moving, fixed = (s[n].reshape(-1, *size[::-1]) for n in ("moving", "fixed"))
        if method == "greedy":
            h, log = greedy_register(moving, fixed, params, levels)
            out = warp(moving, h)
        elif method == "shooting":
            alpha, log = shooting_register(moving, fixed, params, levels)
            out = shoot(moving, alpha, params)[0]
        elif method == "relaxation":
            vs, log = relax_register(moving, fixed, params, levels)
            out = warp(moving, along(vs))
        else:
            m, t, rms, n = affine_registers(moving, fixed, method)
            out = warp(moving, _affine_places(m, t, kernels.identity(size).reshape(3, -1), size[::-1]))
            return {"data": out, "energy": rms, "scale": np.ones_like(rms), "n": n}
        energy = np.stack([e for _, e in log], 1)
        return {"data": out, "energy": energy, "scale": np.repeat([[f for f, _ in log]], len(out), 0), "n": np.full(len(out), energy.shape[1])}

    found = kernels.map_images(pairs, run, ["moving", "fixed"], ["data", "energy", "scale", "n"], ["pair_id"])
    # Pairs of a call may stop after different numbers of iterations.
    done = lambda c: F.slice(c, F.lit(1), F.element_at("n", 1).cast("int"))
    return found.select("pair_id", "data", done("energy").alias("energy"), done("scale").cast("array<int>").alias("scale"))


def energy_events(registered: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, scale, iter, total, change): the history of a registration, one row an iteration; change is null where a level starts."""
    e, s = F.col("energy"), F.col("scale")
    step = F.transform(
        F.sequence(F.lit(0), F.size("energy") - 1),
        lambda i: F.struct(F.get(s, i).alias("scale"), i.alias("iter"), F.get(e, i).alias("total"), F.when(F.get(s, i - 1) == F.get(s, i), F.get(e, i) - F.get(e, i - 1)).alias("change")),
    )
    return registered.filter(F.size("energy") > 0).select(key, F.explode(step).alias("e")).select(key, "e.*")


# Atlases.


def _start(images: DataFrame, atlas: AtlasParams) -> DataFrame:
    if atlas.scale_weights:
        from volspark.operators.aggregate import normal_weights

        images = normal_weights(images, "w", ["cohort"])
    return images.select("cohort", "image_id", "w", "data")


def _mean(state: DataFrame, atlas: AtlasParams, first: bool) -> DataFrame:
    """(cohort, mean) of the deformed images, summed by voxel, so that the partial sums of a task are all that it sends."""
    if atlas.voxel_median:
        voxels = state.select("cohort", F.posexplode("deformed").alias("i", "v"))
        sums = voxels.groupBy("cohort", "i").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m"))
    else:
        if not first and (atlas.median or atlas.trimmed_size):
            state = _reweighted(state, atlas)
        return _weighted_mean(state)
    return sums.groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("mean"))


#: Bytes of partial sums that a task holds before it sends them on.
HELD_BYTES = 256 << 20


def _weighted_mean(state: DataFrame) -> DataFrame:
    """(cohort, mean): a task adds up its images, and sends two images a cohort; those are added up one after the other."""
    kind = pa.schema([pa.field("cohort", to_arrow_type(state.schema["cohort"].dataType)), ("num", pa.list_(pa.float64())), ("den", pa.list_(pa.float64()))])

    def rows(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
        return [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in columns]

    def out(sums: dict) -> Iterator[pa.RecordBatch]:
        for cohort, (num, den) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([cohort], kind.types[0]), pa.array([num], kind.types[1]), pa.array([den], kind.types[2])], schema=kind)

    def partial_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            deformed, jac = rows(batch, 2, 3)
            weights = batch.column(1).to_numpy(zero_copy_only=False)[:, None] * jac
            for i, cohort in enumerate(batch.column(0).to_pylist()):
                if cohort not in sums:
                    sums[cohort] = np.zeros((2, deformed.shape[1]))
                    held += sums[cohort].nbytes
                sums[cohort] += np.stack([weights[i] * deformed[i], weights[i]])
            if held > HELD_BYTES:
                yield from out(sums)
                sums, held = {}, 0
        yield from out(sums)

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def mean() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kind.types[0]), pa.array([total[0] / total[1]], pa.list_(pa.float64()))], names=["cohort", "mean"])

        for batch in batches:
            num, den = rows(batch, 1, 2)
            for i, cohort in enumerate(batch.column(0).to_pylist()):
                if total is not None and cohort == key:
                    total += np.stack([num[i], den[i]])
                    continue
                if total is not None:
                    yield mean()
                key, total = cohort, np.stack([num[i], den[i]])
        if total is not None:
            yield mean()

    of = f"cohort {state.schema['cohort'].dataType.simpleString()}"
    parts = state.select("cohort", F.col("w").cast("double"), "deformed", "jac").mapInArrow(partial_sums, f"{of}, num array<double>, den array<double>")
    return parts.repartition("cohort").sortWithinPartitions("cohort").mapInArrow(totals, f"{of}, mean array<double>")


def _reweighted(state: DataFrame, atlas: AtlasParams) -> DataFrame:
    """Weights by the distance to the last mean: its inverse, or equal ones for the closest images."""
    if atlas.trimmed_size:
        from volspark.operators.order import closest_weights

        kept = closest_weights(state.select("cohort", "image_id", F.col("distance").alias("dist")), F.least(F.lit(atlas.trimmed_size), F.col("n")), ["cohort"])
        state = state.drop("w").join(kept, ["cohort", "image_id"])
    if atlas.median:
        state = state.withColumn("w", F.col("w") / F.sqrt(F.greatest("distance", F.lit(1e-12))))
    return state


def build_atlas(images: DataFrame, size: Size, params: GreedyParams | LDMMParams, atlas: AtlasParams = AtlasParams(), levels: Sequence[Level] = FULL) -> tuple[DataFrame, DataFrame]:
    """(mean, images) of each cohort from images (cohort, image_id, w, data), one step of every image in each iteration.

    With GreedyParams, images move towards the mean and are averaged as moved.
    With LDMMParams, the mean moves towards the images along velocities, and they
    are averaged as pulled back to it, by their change of volume if the atlas
    says so. The state of an image is ``f``, its places or velocities.
    """
    greedy = isinstance(params, GreedyParams)
    times = 1 if greedy else params.time_steps
    full = _start(images, atlas)
    state, old = None, None
    keep = ["cohort", "image_id", "w"]
    for level in levels:
        now, factor = level_size(size, level.factor), level.factor

        def begin(s: kernels.Stacks, now=now, old=old, factor=factor) -> kernels.Stacks:
            data = to_level(s["data"].reshape(-1, *size[::-1]), factor)
            if "f" not in s:
                f = np.repeat(_x(data), len(data), 0) if greedy else np.zeros((len(data), times, 3, *now[::-1]))
            elif greedy:
                f = kernels.resize_places(s["f"].reshape(-1, 3, *old[::-1]), now)
            else:
                v = s["f"].reshape(-1, times, 3, *old[::-1])
                f = np.stack([_finer(v[:, t], now) for t in range(times)], 1)
            if greedy:
                deformed, jac = warp(data, f), np.ones_like(data)
            else:
                x = _x(data)
                back = np.repeat(x, len(data), 0)
                for t in range(times - 1, -1, -1):
                    back = _then(back, x + f[:, t])
                deformed, jac = warp(data, back), jacobian(back) if atlas.jacobian_scale else np.ones_like(data)
            return {"level": data, "f": f, "step": np.full((len(data), 1), np.nan), "deformed": deformed, "jac": jac}

        source = full if state is None else full.join(state.select("image_id", "f"), "image_id")
        out = ["level", "f", "step", "deformed", "jac"]
        state = kernels.map_images(source, begin, ["data"] if state is None else ["data", "f"], out, keep)
        state = state.withColumns({"energy": F.lit(0.0), "distance": F.lit(0.0)})

        def step(s: kernels.Stacks, now=now) -> kernels.Stacks:
            data, mean = s["level"].reshape(-1, *now[::-1]), s["mean"].reshape(-1, *now[::-1])
            if greedy:
                f, delta, energy = greedy_step(data, mean, s["f"].reshape(-1, 3, *now[::-1]), s["step"][:, 0], params)
                deformed, jac = warp(data, f), np.ones_like(data)
            else:
                f, delta, energy, deformed, jac = relax_step(mean, data, s["f"].reshape(-1, times, 3, *now[::-1]), s["step"][:, 0], params)
                jac = jac if atlas.jacobian_scale else np.ones_like(jac)
            return {"level": data, "f": f, "step": delta, "deformed": deformed, "jac": jac, "energy": energy, "distance": _sum((deformed - mean) ** 2)}

        for k in range(params.iterations if level.iterations is None else level.iterations):
            state = cut(state)
            joined = _with_mean(state, _mean(state, atlas, k == 0), now)
            moved = kernels.map_images(joined, step, ["level", "f", "step", "mean"], [*out, "energy", "distance"], keep)
            state = moved.withColumns({c: F.element_at(c, 1) for c in ("energy", "distance")})
        old = now
    state = cut(state)
    return _mean(state, atlas, False), state


def _with_mean(state: DataFrame, means: DataFrame, size: Size) -> DataFrame:
    """Images with the mean of their cohort, which is sent to all tasks only if all means are small."""
    means = cut(means)
    small = means.count() * size[0] * size[1] * size[2] * 8 <= BROADCAST_BYTES
    return state.join(F.broadcast(means) if small else means, "cohort")


def affine_atlas(images: DataFrame, size: Size, mode: str = "affine", rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(mean, images) of each cohort: in each round every image is registered to the mean anew, and the moved images are averaged."""
    atlas = AtlasParams(jacobian_scale=False)
    ones = lambda c: F.transform(c, lambda _: F.lit(1.0))
    state = _start(images, atlas).withColumns({"deformed": F.col("data"), "jac": ones("data"), "energy": F.lit(0.0)})

    def run(s: kernels.Stacks) -> kernels.Stacks:
        data, mean = s["data"].reshape(-1, *size[::-1]), s["mean"].reshape(-1, *size[::-1])
        m, t, rms, n = affine_registers(data, mean, mode)
        places = _affine_places(m, t, kernels.identity(size).reshape(3, -1), size[::-1])
        return {"data": data, "deformed": warp(data, places, None), "jac": np.ones_like(data), "energy": rms[np.arange(len(n)), n - 1]}

    for _ in range(rounds):
        state = cut(state)
        joined = _with_mean(state, _mean(state, atlas, True), size)
        found = kernels.map_images(joined, run, ["data", "mean"], ["data", "deformed", "jac", "energy"], ["cohort", "image_id", "w"])
        state = found.withColumn("energy", F.element_at("energy", 1))
    state = cut(state)
    return _mean(state, atlas, True), state
