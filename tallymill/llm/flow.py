"""Minimum-cost flow on small networks, by shortest augmenting paths with potentials."""

from __future__ import annotations

import heapq


class Network:
    """Nodes are any hashable values; capacities and costs are non-negative integers."""

    def __init__(self) -> None:
        self.of: dict[object, int] = {}
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self, x: object) -> int:
        if x not in self.of:
            self.of[x] = len(self.of)
            self.out.append([])
        return self.of[x]

    def arc(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        u, v = self.node(a), self.node(b)
        for s, t, room, c in ((u, v, capacity, cost), (v, u, 0, -cost)):
            self.out[s].append(len(self.to))
            self.to.append(t)
            self.room.append(room)
            self.cost.append(c)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def send(self, a: object, b: object) -> tuple[int, int]:
        """Send as much as possible at least cost; gives the amount and its cost.

        Primal-dual: one search for the cheapest distance, then blocking flows over the arcs that lie
        on cheapest paths, until none is left at this distance.
        """
        s, t, n = self.node(a), self.node(b), len(self.of)
        high, amount, price = [0] * n, 0, 0
        while True:
            far: list[float] = [float("inf")] * n
            far[s] = 0
            queue: list[tuple[float, int]] = [(0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    if self.room[e] > 0:
                        nd = d + self.cost[e] + high[u] - high[self.to[e]]
                        if nd < far[self.to[e]]:
                            far[self.to[e]] = nd
                            heapq.heappush(queue, (nd, self.to[e]))
            if far[t] == float("inf"):
                return amount, price
            most = max(x for x in far if x < float("inf"))
            for v in range(n):
                high[v] += int(min(far[v], most))
            while got := self._blocking(s, t, high):
                amount += got
                price += got * (high[t] - high[s])

    def _blocking(self, s: int, t: int, high: list[int]) -> int:
        level = {s: 0}
        line = [s]
        for u in line:
            for e in self.out[u]:
                v = self.to[e]
                if self.room[e] > 0 and v not in level and self.cost[e] + high[u] == high[v]:
                    level[v] = level[u] + 1
                    line.append(v)
        if t not in level:
            return 0
        total, at, path = 0, dict.fromkeys(level, 0), []
        u = s
        while True:
            if u == t:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                total += push
                path, u = [], s
                continue
            while at[u] < len(self.out[u]):
                e = self.out[u][at[u]]
                v = self.to[e]
                if self.room[e] > 0 and level.get(v, -1) == level[u] + 1 and self.cost[e] + high[u] == high[v]:
                    break
                at[u] += 1
            if at[u] < len(self.out[u]):
                path.append(self.out[u][at[u]])
                u = self.to[path[-1]]
            elif path:
                e = path.pop()
                u = self.to[e ^ 1]
                at[u] += 1
            else:
                return total
