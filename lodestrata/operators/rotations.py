"""Rotations as quaternions (w, x, y, z) that turn the body's frame to the world's; the last axis holds the parts, any others are free."""

from __future__ import annotations

import numpy as np

UP = np.array([0.0, 0.0, 1.0])
IDENTITY = np.array([1.0, 0.0, 0.0, 0.0])


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, b)


def norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt(dot(v, v))


def unit(v: np.ndarray) -> np.ndarray:
    """Of length one; what has no length stays."""
    n = norm(v)[..., None]
    return np.where(n > 1e-12, v / np.where(n > 1e-12, n, 1.0), v)


def multiply(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(np.asarray(p, float), -1, 0)
    a, b, c, d = np.moveaxis(np.asarray(q, float), -1, 0)
    return np.stack([w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a], axis=-1)


def conjugate(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1.0, -1.0, -1.0])


def rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v in the frame that q turns it to."""
    u, v = q[..., 1:], np.asarray(v, float)
    return v + 2 * np.cross(u, np.cross(u, v) + q[..., :1] * v)


def exponential(w: np.ndarray) -> np.ndarray:
    """The turn by the rotation vector w."""
    a = norm(w)[..., None]
    s = np.where(a < 1e-9, 0.5, np.sin(a / 2) / np.where(a < 1e-9, 1.0, a))
    return np.concatenate([np.cos(a / 2), s * w], axis=-1)


def logarithm(q: np.ndarray) -> np.ndarray:
    """The rotation vector of a turn, at most half a turn long."""
    q = np.where(q[..., :1] < 0, -q, q)
    s = norm(q[..., 1:])[..., None]
    a = 2 * np.arctan2(s, q[..., :1])
    return np.where(s < 1e-12, 2.0, a / np.where(s < 1e-12, 1.0, s)) * q[..., 1:]


def shortest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest turn of direction a to b; of opposite ones some half turn."""
    a, b = np.broadcast_arrays(unit(np.asarray(a, float)), unit(np.asarray(b, float)))
    d = dot(a, b)[..., None]
    side = unit(np.cross(a, np.where(np.abs(a[..., :1]) < 0.9, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])))
    near = unit(np.concatenate([1 + d, np.cross(a, b)], axis=-1))
    return np.where(d < -1 + 1e-9, np.concatenate([np.zeros_like(d), side], axis=-1), near)


def geodesic(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The angle between two orientations in radians."""
    return 2 * np.arccos(np.clip(np.abs(dot(p, q)), 0.0, 1.0))


def slerp(p: np.ndarray, q: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The orientation a part of the way from p to q, the shorter way."""
    return multiply(p, exponential(np.asarray(part)[..., None] * logarithm(multiply(conjugate(p), q))))


def matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(q, -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=-2)


def six(q: np.ndarray) -> np.ndarray:
    """The first two columns of the matrix, a form without jumps."""
    m = matrix(q)
    return np.concatenate([m[..., 0], m[..., 1]], axis=-1)


def mirror(q: np.ndarray) -> np.ndarray:
    """The orientation seen in a mirror across the body's and the world's x axis, as of the other hand."""
    return q * np.array([1.0, 1.0, -1.0, -1.0])


def skew(v: np.ndarray) -> np.ndarray:
    """The matrix that takes the cross product with v."""
    z = np.zeros(v.shape[:-1])
    x, y, w = np.moveaxis(np.asarray(v, float), -1, 0)
    return np.stack([np.stack([z, -w, y], -1), np.stack([w, z, -x], -1), np.stack([-y, x, z], -1)], -2)


def yaw_between(estimate: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """The turn about the vertical that brings a series of orientations closest to another: the mean of their differences, without tilt."""
    r = multiply(truth, conjugate(estimate))
    r = np.where(r[..., :1] < 0, -r, r)
    w, z = r[:, 0].sum(), r[:, 3].sum()
    return unit(np.array([w, 0.0, 0.0, z])) if w * w + z * z > 1e-18 else IDENTITY


def swing_twist(q: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(swing, twist) of q = swing * twist, the twist about an axis of the body; no twist where it is undefined."""
    along = dot(q[..., 1:], axis)[..., None] * axis
    twist = np.concatenate([q[..., :1], along], axis=-1)
    n = norm(twist)[..., None]
    twist = np.where(n > 1e-9, twist / np.where(n > 1e-9, n, 1.0), IDENTITY)
    return multiply(q, conjugate(twist)), twist
