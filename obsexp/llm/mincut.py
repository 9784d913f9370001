"""Minimum cut over a small graph whose nodes each lean to one of two labels."""

from __future__ import annotations

from collections import deque

EPS = 1e-9


def cut_labels(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost.

    Node i costs ``lean[i]`` when labelled False and nothing otherwise (a negative lean costs its size when True); an
    edge costs its weight when its ends differ. Nodes whose lean outweighs all their edges are fixed first and their
    edges folded into their neighbours' leans; that never changes the minimum. The rest goes to maximum flow. Of several
    minima the one with the fewest True nodes is returned.
    """
    lean = list(lean)
    near: list[dict[int, float]] = [{} for _ in lean]
    for u, v, w in edges:
        if u != v and w > 0:
            near[u][v] = near[u].get(v, 0.0) + w
            near[v][u] = near[v].get(u, 0.0) + w
    label: list[bool | None] = [None] * len(lean)
    bond = [sum(n.values()) for n in near]
    queue = deque(range(len(lean)))
    while queue:
        u = queue.popleft()
        if label[u] is None and abs(lean[u]) > bond[u] + EPS:
            label[u] = lean[u] > 0
            for v, w in near[u].items():
                if label[v] is None:
                    bond[v] -= w
                    lean[v] += w if label[u] else -w
                    queue.append(v)
    left = [u for u, x in enumerate(label) if x is None]
    if left:
        place = {u: i for i, u in enumerate(left)}
        links = [(place[u], place[v], w) for u in left for v, w in near[u].items() if v in place and u < v]
        reached = _max_flow([lean[u] for u in left], links)
        for u, i in place.items():
            label[u] = reached[i]
    return [bool(x) for x in label]


def _max_flow(lean: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay reachable from the source after maximum flow (level graphs and blocking flows)."""
    n = len(lean)
    source, sink = n, n + 1
    head: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(head))
        head.append(v)
        room.append(there)
        out[v].append(len(head))
        head.append(u)
        room.append(back)

    for u, x in enumerate(lean):
        if x > 0:
            connect(source, u, x, 0.0)
        elif x < 0:
            connect(u, sink, -x, 0.0)
    for u, v, w in links:
        connect(u, v, w, w)

    def levels() -> list[int]:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > EPS and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        return level

    level = levels()
    while level[sink] >= 0:
        following = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= EPS)
                u = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[u] < len(out[u]):
                e = out[u][following[u]]
                if room[e] > EPS and level[head[e]] == level[u] + 1:
                    break
                following[u] += 1
            if following[u] < len(out[u]):
                path.append(out[u][following[u]])
                u = head[path[-1]]
            elif path:
                u = head[path.pop() ^ 1]
                following[u] += 1
            else:
                break
        level = levels()
    return [x >= 0 for x in level[:n]]
