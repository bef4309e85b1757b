"""Operators of whole volumes: Fourier kernels and recursive filters, one task row an image."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from volspark.operators import kernels
from volspark.operators.grid import Size


def operator_matrices(size: Size, spacing: tuple[float, float, float], alpha: float, beta: float, gamma: float) -> np.ndarray:
    """(sz, sy, sx, 3, 3): the symmetric matrix of L = -alpha laplacian - beta grad div + gamma at each frequency."""
    w = [2 * np.pi * np.arange(n) / n for n in size]
    c = [(2 * np.cos(a) - 2) / s**2 for a, s in zip(w, spacing, strict=True)]
    d = [np.sin(a) / s for a, s in zip(w, spacing, strict=True)]
    shape = [(1, 1, -1), (1, -1, 1), (-1, 1, 1)]
    c, d = [x.reshape(k) for x, k in zip(c, shape, strict=True)], [x.reshape(k) for x, k in zip(d, shape, strict=True)]
    out = np.zeros((*size[::-1], 3, 3))
    diagonal = gamma - alpha * (c[0] + c[1] + c[2])
    for i in range(3):
        for j in range(3):
            out[..., i, j] = diagonal - beta * c[i] if i == j else beta * d[i] * d[j]
    return out


_SHAPES = [(1, 1, -1), (1, -1, 1), (-1, 1, 1)]


def apply_operator(field: np.ndarray, size: Size, spacing=(1.0, 1.0, 1.0), alpha=0.01, beta=0.01, gamma=0.001, power=1.0, inverse=False, incompressible=False) -> np.ndarray:
    """L^power or its inverse of a field or a stack (..., 3, z, y, x); optionally projected to be free of divergence."""
    axes = (-3, -2, -1)
    f = np.moveaxis(np.fft.fftn(field, axes=axes), -4, -1)
    m = operator_matrices(size, spacing, alpha, beta, gamma)
    if power != 1.0:
        values, vectors = np.linalg.eigh(m)
        values = np.maximum(values, 1e-12) ** (-power if inverse else power)
        f = (np.einsum("...ij,...j,...kj->...ik", vectors, values, vectors) @ f[..., None])[..., 0]
    elif inverse:
        f = np.linalg.solve(m, f[..., None])[..., 0]
    else:
        f = (m @ f[..., None])[..., 0]
    if incompressible:
        s = np.stack(np.broadcast_arrays(*[(np.sin(2 * np.pi * np.arange(n) / n) / sp).reshape(k) for n, sp, k in zip(size, spacing, _SHAPES, strict=True)]), -1)
        sq = (s**2).sum(-1, keepdims=True)
        f = f - np.where(sq > 1e-12, (f * s).sum(-1, keepdims=True) / np.where(sq > 1e-12, sq, 1), 0) * s
    return np.fft.ifftn(np.moveaxis(f, -1, -4), axes=axes).real


def kernel(fields: DataFrame, size: Size, **options) -> DataFrame:
    """Apply L (or K = L^-1 with inverse=True) to dense fields (image_id, ux, uy, uz arrays)."""
    names = ("ux", "uy", "uz")

    def run(s: kernels.Stacks) -> kernels.Stacks:
        out = apply_operator(np.stack([s[n].reshape(-1, *size[::-1]) for n in names], 1), size, **options)
        return {n: out[:, i] for i, n in enumerate(names)}

    return kernels.map_images(fields, run, names, names)


def gaussian_response(size: Size, sigmas: Sequence[float], weights: Sequence[float], spacing: Sequence[float] = (1, 1, 1)) -> np.ndarray:
    """(z, y, x): the Fourier transform of a weighted sum of periodic Gaussians, with weights normalised to 1."""
    w = [2 * np.pi * np.fft.fftfreq(n) / s for n, s in zip(size, spacing, strict=True)]
    square = sum((a.reshape(k) ** 2 for a, k in zip(w, _SHAPES, strict=True)), np.zeros(size[::-1]))
    return sum((p / sum(weights) * np.exp(-square * s * s / 2) for s, p in zip(sigmas, weights, strict=True)), np.zeros(size[::-1]))


def convolve(images: DataFrame, size: Size, response: np.ndarray, values: Sequence[str] = ("data",)) -> DataFrame:
    """The arrays ``values`` convolved by a kernel that is given by its Fourier transform, one transform there and one back."""

    def run(s: kernels.Stacks) -> kernels.Stacks:
        axes = (1, 2, 3)
        return {n: np.fft.ifftn(np.fft.fftn(s[n].reshape(-1, *size[::-1]), axes=axes) * response, axes=axes).real for n in values}

    return kernels.map_images(images, run, values, values)


def multi_gaussian(fields: DataFrame, size: Size, sigmas: Sequence[float], weights: Sequence[float], spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """A field smoothed by a weighted sum of Gaussians, component by component."""
    return convolve(fields, size, gaussian_response(size, sigmas, weights, spacing), ("ux", "uy", "uz"))


def sinc_upsample(volume: np.ndarray, factor: int) -> np.ndarray:
    """Fourier zero padding of a (sz, sy, sx) volume."""
    f = np.fft.fftshift(np.fft.fftn(volume))
    pads = [(n * factor // 2 - n // 2, n * factor - n - (n * factor // 2 - n // 2)) for n in volume.shape]
    return np.fft.ifftn(np.fft.ifftshift(np.pad(f, pads))).real * factor**3


def recursive_gaussian(values: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    """Forward and backward exponential passes, three times, with the variance of a Gaussian."""
    q = sigma**2 / 6
    a = (1 + q - np.sqrt(1 + 2 * q)) / q if q > 0 else 0.0
    x = np.moveaxis(np.array(values, dtype=np.float64), axis, 0)
    for _ in range(3):
        for order in (range(1, len(x)), range(len(x) - 2, -1, -1)):
            step = 1 if order.step == 1 else -1
            for i in order:
                x[i] = (1 - a) * x[i] + a * x[i - step]
    return np.moveaxis(x, 0, axis)


def recursive_blur(images: DataFrame, size: Size, sigma: Sequence[float]) -> DataFrame:
    """``data`` after recursive filters along x, y and z."""

    def run(s: kernels.Stacks) -> kernels.Stacks:
        v = s["data"].reshape(-1, *size[::-1])
        for axis, width in enumerate(sigma):
            v = recursive_gaussian(v, width, 3 - axis) if width > 0 else v
        return {"data": v}

    return kernels.map_images(images, run, ["data"], ["data"])
