"""Pixel operations of the face and embedding pipelines, in numpy; images are height x width x 3 arrays."""

from __future__ import annotations

import numpy as np

# The five landmarks of an aligned 112-pixel face, and the detector's strides and thresholds.
ALIGNED = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
STRIDES, ANCHORS, CONFIDENCE, OVERLAP = (8, 16, 32), 2, 0.5, 0.4


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Triangle-filter resampling to an exact size."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        scale = max(1.0, n_in / n_out)
        centre = (np.arange(n_out) + 0.5) * n_in / n_out
        w = np.maximum(0.0, 1 - np.abs(np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / scale)
        return w / w.sum(1, keepdims=True)

    return np.einsum("hi,ijc,wj->hwc", weights(image.shape[0], height), image.astype(np.float64), weights(image.shape[1], width), optimize=True)


def image_to_tensor(image: np.ndarray, size: int) -> np.ndarray:
    """Channels first, scaled to -1 .. 1."""
    return ((np.rint(resize(image, size, size)) / 255.0 - 0.5) / 0.5).transpose(2, 0, 1).astype(np.float32)


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 rotation, scale and shift that maps points closest onto others."""
    ms, mt = source.mean(0), target.mean(0)
    s, t = source - ms, target - mt
    u, d, vt = np.linalg.svd(t.T @ s / len(s))
    sign = np.diag([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = u @ sign @ vt
    spread = (s**2).sum() / len(s)
    scale = (d * np.diag(sign)).sum() / spread if spread > 0 else 1.0
    return np.column_stack([scale * rotation, mt - scale * rotation @ ms])


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; black outside the image."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, image.shape[2]))
    for dx in (0, 1):
        for dy in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            inside = (xi >= 0) & (yi >= 0) & (xi < image.shape[1]) & (yi < image.shape[0])
            w = np.where(dx, x - x0, 1 - (x - x0)) * np.where(dy, y - y0, 1 - (y - y0)) * inside
            out += w[..., None] * image[np.clip(yi, 0, image.shape[0] - 1), np.clip(xi, 0, image.shape[1] - 1)]
    return out


def warp(image: np.ndarray, transform: np.ndarray, size: int) -> np.ndarray:
    """A square of the image, seen through a 2 x 3 map from image to square."""
    back = np.linalg.inv(np.vstack([transform, [0, 0, 1]]))
    ys, xs = np.mgrid[0:size, 0:size]
    x, y, _ = np.tensordot(back, np.stack([xs, ys, np.ones_like(xs)]), 1)
    return sample(image, x, y)


def align_face(image: np.ndarray, landmarks: np.ndarray, size: int = 112) -> np.ndarray:
    return warp(image, similarity_transform(np.asarray(landmarks, float), ALIGNED * size / 112), size)


def orient(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned upright from its EXIF orientation, 1 to 8."""
    turned = np.transpose(image, (1, 0, 2)) if orientation >= 5 else image
    if orientation in (2, 3, 6, 7):
        turned = turned[:, ::-1]
    if orientation in (3, 4, 7, 8):
        turned = turned[::-1]
    return turned


def crop_face(image: np.ndarray, box: tuple[float, float, float, float], pad: float = 0.25, size: int = 140) -> np.ndarray:
    """A padded square around an x, y, w, h box, within the image, resized."""
    x, y, w, h = box
    side = min(max(w, h) * (1 + 2 * pad), *image.shape[:2])
    left = int(min(max(0, x + w / 2 - side / 2), image.shape[1] - side))
    top = int(min(max(0, y + h / 2 - side / 2), image.shape[0] - side))
    return resize(image[top : top + max(1, int(side)), left : left + max(1, int(side))], size, size)


def decode_detections(outputs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], input_size: int, scale: float) -> list[dict]:
    """Boxes and landmarks from a detector's scores, distances and offsets by stride, best first, overlaps removed."""
    found = []
    for stride, (scores, distances, offsets) in outputs.items():
        side = input_size // stride
        ys, xs = np.mgrid[0:side, 0:side]
        centre = np.repeat(np.stack([xs, ys], 2).reshape(-1, 2) * stride, ANCHORS, 0).astype(float)
        for k in np.flatnonzero(scores.reshape(-1) >= CONFIDENCE):
            left, top, right, bottom = distances.reshape(-1, 4)[k] * stride
            cx, cy = centre[k]
            marks = centre[k] + offsets.reshape(-1, 5, 2)[k] * stride
            found.append({"bbox": [(cx - left) / scale, (cy - top) / scale, (cx + right) / scale, (cy + bottom) / scale], "score": float(scores.reshape(-1)[k]), "landmarks": (marks / scale).tolist()})
    found.sort(key=lambda f: -f["score"])
    kept: list[dict] = []
    for f in found:
        if all(iou(f["bbox"], g["bbox"]) <= OVERLAP for g in kept):
            kept.append(f)
    return kept


def iou(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)
