"""What a cache of units keeps when it is full."""

import numpy as np

from spanweave.llm._units import UnitCache


def test_units_that_come_again_stay():
    made = []

    def make(units):
        made.extend(units)
        sizes = np.array([len(u) for u in units])
        return np.concatenate([np.frombuffer(u.encode("utf-32-le"), np.int32) for u in units]), sizes, sizes.astype(float)

    cache = UnitCache(make, 1, most=40)
    for call in range(60):
        units = ["often", "common", *[f"rare{call}-{i}" for i in range(8)]]
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(u) for u in units])
        place = cache.places(points, end - [len(u) for u in units], end)
        for u, at in zip(units, place.tolist()):
            got = cache.flat[cache.start[at] : cache.start[at] + cache.size[at]]
            assert got.astype("<i4").tobytes().decode("utf-32-le") == u and cache.extra[0][at] == len(u)
    assert made.count("often") == made.count("common") == 1 and len(cache.known) <= 60
