"""Local union of matched pairs inside one task, with numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over 0..n-1 whose root is always the least member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Unites many pairs at once: the larger root of each pair is hung under the smaller until nothing changes."""
        root = self.root
        while len(x):
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                return
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
