"""A reader of small paged files for tests: JSON with a list of pages; ``bad`` pages cannot be read."""

import json


class Paged:
    def _all(self, path):
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def count(self, path):
        return len(self._all(path))

    def read(self, path, pages):
        every = self._all(path)
        for n in pages:
            p = dict(every[n - 1])
            if p.pop("bad", False):
                raise ValueError("bad page")
            gray = p.pop("ink", None)
            if gray is not None:
                w, h = 600, 800
                g = bytearray(b"\xff" * (w * h))
                for x1, y1, x2, y2 in gray:
                    for y in range(y1, y2):
                        g[y * w + x1 : y * w + x2] = b"\x10" * (x2 - x1)
                p |= {"width": w, "height": h, "dpi": 72, "gray": bytes(g)}
            yield {"page": n, "page_w": 600.0, "page_h": 800.0} | p


def make():
    return Paged()
