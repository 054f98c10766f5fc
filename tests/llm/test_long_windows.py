"""Windows of more bytes than fit into one."""

import random

import pytest

from weftgraph.llm import suffixes


@pytest.mark.parametrize("window", [200, 254, 255, 300, 700])
def test_only_whole_windows_repeat(window):
    r = random.Random(window)
    some = bytes(r.randrange(97, 123) for _ in range(window + 40))
    short = bytes(r.randrange(97, 123) for _ in range(window - 1))
    pieces = [b"x" + some + b"1", b"y" + some + b"2", b"q" + short + b"5", b"p" + short + b"6", b"a" * (window + 3)]
    count: dict[bytes, int] = {}
    for p in pieces:
        for i in range(len(p) - window + 1):
            count[p[i : i + window]] = count.get(p[i : i + window], 0) + 1
    want, begin = [], 0
    for p in pieces:
        want += [begin + i for i in range(len(p) - window + 1) if count[p[i : i + window]] > 1]
        begin += len(p) + 1
    for memory in (100, 1 << 20):
        assert suffixes.repeated_starts(pieces, window, memory=memory).tolist() == want
