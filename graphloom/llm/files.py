"""Arrays as files in the shared folder."""

from __future__ import annotations

import numpy as np

from graphloom.files import reading, writing

__all__ = ["load_array", "reading", "save_array", "writing"]


def save_array(uri: str, array: np.ndarray) -> None:
    with writing(uri) as out:
        np.save(out, array)


def load_array(uri: str) -> np.ndarray:
    with reading(uri) as f:
        return np.load(f)
