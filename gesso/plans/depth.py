"""Depth from gradients: frequency, cosine and sparse solvers.

Images are cut into blocks; a task holds a strip of full lines (transforms)
or one tile (sparse solver), never a whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.operators import grid as gr
from gesso.plans import tiles

STRIP = 32


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def _separable(
    df: DataFrame, columns: Sequence[str], rows_in: Callable, middle: Callable, rows_out: Callable, strip: int = STRIP
) -> DataFrame:
    """Transform along x, work along y, transform back along x: ``z`` per pixel.

    ``rows_in(planes) -> complex (k, ny, w)`` on strips of full rows,
    ``middle(block, x0, h, w) -> complex (h, nx)`` on strips of full columns,
    ``rows_out(block) -> float (ny, w)``. Strips travel as arrays, so the two
    transposing shuffles move blocks and not pixels.
    """
    kind = _kind(df)
    sized = gr.with_dims(df.select(*gr.KEY, *columns)).withColumn("_yb", F.floor(F.col("y") / strip).cast("int"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h, yb = int(pdf["_w"].iloc[0]), int(pdf["_h"].iloc[0]), int(pdf["_yb"].iloc[0])
        y0 = yb * strip
        ny = min(strip, h - y0)
        planes = np.zeros((len(columns), ny, w))
        iy, ix = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy()
        for i, c in enumerate(columns):
            planes[i, iy, ix] = pdf[c].to_numpy()
        spec = rows_in(planes)
        out = []
        for x0 in range(0, w, strip):
            part = spec[:, :, x0 : x0 + strip]
            out.append((pdf["image_id"].iloc[0], yb, x0 // strip, h, w, part.real.ravel().tolist(), part.imag.ravel().tolist()))
        return pd.DataFrame(out, columns=["image_id", "yb", "xb", "h", "w", "re", "im"])

    schema = f"image_id {kind}, yb int, xb int, h int, w int, re array<double>, im array<double>"
    spec = sized.groupBy("image_id", "_yb").applyInPandas(first, schema)

    def columns_step(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, xb = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), int(pdf["xb"].iloc[0])
        x0 = xb * strip
        nx = min(strip, w - x0)
        block = None
        for yb, re, im in zip(pdf["yb"], pdf["re"], pdf["im"]):
            y0 = yb * strip
            ny = min(strip, h - y0)
            part = (np.asarray(re) + 1j * np.asarray(im)).reshape(-1, ny, nx)
            if block is None:
                block = np.zeros((part.shape[0], h, nx), complex)
            block[:, y0 : y0 + ny] = part
        done = middle(block, x0, h, w)
        out = []
        for y0 in range(0, h, strip):
            part = done[y0 : y0 + strip]
            out.append((pdf["image_id"].iloc[0], y0 // strip, xb, h, w, part.real.ravel().tolist(), part.imag.ravel().tolist()))
        return pd.DataFrame(out, columns=["image_id", "yb", "xb", "h", "w", "re", "im"])

    back = spec.groupBy("image_id", "xb").applyInPandas(columns_step, schema)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, yb = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), int(pdf["yb"].iloc[0])
        y0 = yb * strip
        ny = min(strip, h - y0)
        block = np.zeros((ny, w), complex)
        for xb, re, im in zip(pdf["xb"], pdf["re"], pdf["im"]):
            x0 = xb * strip
            nx = min(strip, w - x0)
            block[:, x0 : x0 + nx] = (np.asarray(re) + 1j * np.asarray(im)).reshape(ny, nx)
        z = rows_out(block)
        yy, xx = np.mgrid[y0 : y0 + ny, 0:w]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": yy.ravel(), "x": xx.ravel(), "z": z.ravel()})

    return back.groupBy("image_id", "yb").applyInPandas(last, f"image_id {kind}, y int, x int, z double")


def integrate_fft(grad: DataFrame, low_pass: float | None = None, strip: int = STRIP) -> DataFrame:
    """Frankot-Chellappa integration of p, q with periodic borders; mean 0.

    ``low_pass`` is the spread, in cycles per pixel, of a Gaussian on the spectrum.
    """

    def middle(block: np.ndarray, x0: int, h: int, w: int) -> np.ndarray:
        nx = block.shape[2]
        p, q = np.fft.fft(block, axis=1)
        fu = np.fft.fftfreq(w)[x0 : x0 + nx][None, :]
        fv = np.fft.fftfreq(h)[:, None]
        u, v = 2 * np.pi * fu, 2 * np.pi * fv
        d = u**2 + v**2
        z = np.where(d > 0, (-1j * u * p - 1j * v * q) / np.where(d > 0, d, 1), 0)
        if low_pass:
            z = z * np.exp(-(fu**2 + fv**2) / (2 * low_pass**2))
        return np.fft.ifft(z, axis=0)

    return _separable(grad, ["p", "q"], lambda a: np.fft.fft(a, axis=2), middle, lambda b: np.fft.ifft(b, axis=1).real, strip)


def dct(a: np.ndarray, axis: int) -> np.ndarray:
    """Type-2 cosine transform by an FFT of the mirrored line."""
    a = np.moveaxis(a, axis, -1)
    n = a.shape[-1]
    spec = np.fft.fft(np.concatenate([a, a[..., ::-1]], axis=-1), axis=-1)[..., :n]
    out = (spec * np.exp(-1j * np.pi * np.arange(n) / (2 * n))).real
    return np.moveaxis(out, -1, axis)


def idct(a: np.ndarray, axis: int) -> np.ndarray:
    """Inverse of ``dct``."""
    a = np.moveaxis(a, axis, -1)
    n = a.shape[-1]
    half = a * np.exp(1j * np.pi * np.arange(n) / (2 * n))
    full = np.concatenate([half, np.zeros_like(half[..., :1]), np.conj(half[..., :0:-1])], axis=-1)
    return np.moveaxis(np.fft.ifft(full, axis=-1).real[..., :n], -1, axis)


def integrate_dct(grad: DataFrame, strip: int = STRIP, tile: int = gr.TILE) -> DataFrame:
    """Poisson equation of the gradient divergence with free borders; mean 0."""
    div = gr.divergence(grad.select(*gr.KEY, "p", "q"), tile=tile).select(*gr.KEY, "div")

    def middle(block: np.ndarray, x0: int, h: int, w: int) -> np.ndarray:
        nx = block.shape[2]
        spec = dct(block[0].real, 0)
        lam = (2 * np.cos(np.pi * np.arange(h) / h) - 2)[:, None] + (2 * np.cos(np.pi * np.arange(x0, x0 + nx) / w) - 2)[None, :]
        return idct(np.where(lam != 0, spec / np.where(lam != 0, lam, 1), 0), 0).astype(complex)

    return _separable(div, ["div"], lambda a: dct(a, 2).astype(complex), middle, lambda b: idct(b.real, 1), strip)


# -- sparse solver ----------------------------------------------------------------------


def integrate_poisson(grad: DataFrame, tile: int = 256, tolerance: float = 1e-5, max_steps: int = 2000) -> tuple[DataFrame, int, float]:
    """Depth of masked gradients (p, q, valid): least squares over the links
    between valid neighbours, natural borders, minimum of each image at 0.
    Returns (depth, steps, relative residual); see ``tiles.conjugate_gradients``."""
    return tiles.conjugate_gradients(grad, tile, tolerance, max_steps)


def integrate_poisson_tiled(grad: DataFrame, tile: int = 4096, overlap: int = 256, tolerance: float = 1e-5, max_sweeps: int = 500, relax: float = 1.0) -> tuple[DataFrame, int, float]:
    """The same by sweeps over overlapping tiles: (depth, sweeps, relative residual); see ``tiles.schwarz_sweeps``."""
    return tiles.schwarz_sweeps(grad, tile, overlap, tolerance, max_sweeps, relax)
