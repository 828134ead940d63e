"""Sets of sources over the value graph of one file: function summaries first, then what reaches each sink.

The graph's edges come from joins (see taint_rules); what is here is the walk over the edges of a single file.
"""

from __future__ import annotations

from collections import defaultdict

from ..plans.rules import satisfied


class Program:
    """Edges of a file. calls: call -> functions that it may be; arguments: call -> [(argument, function, parameter)]."""

    def __init__(self):
        self.next: dict[int, list[int]] = defaultdict(list)
        self.arguments: list[tuple[int, int, int, int]] = []  # argument, call, function, parameter
        self.calls: dict[int, list[int]] = defaultdict(list)  # function -> calls of it
        self.returns: dict[int, list[int]] = defaultdict(list)  # function -> its return statements
        self.called_in: dict[int, set[int]] = defaultdict(set)  # function -> functions that its body calls
        self.parameters: dict[int, list[int]] = defaultdict(list)

    def components(self) -> list[list[int]]:
        """Functions that call each other, callees before callers (Tarjan's algorithm without recursion)."""
        index, low, on, stack, out = {}, {}, set(), [], []
        for root in list(self.parameters):
            if root in index:
                continue
            work = [(root, iter(self.called_in[root]))]
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
            while work:
                f, callees = work[-1]
                for g in callees:
                    if g not in index:
                        index[g] = low[g] = len(index)
                        stack.append(g)
                        on.add(g)
                        work.append((g, iter(self.called_in[g])))
                        break
                    if g in on:
                        low[f] = min(low[f], index[g])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[f])
                    if low[f] == index[f]:
                        group = []
                        while not group or group[-1] != f:
                            group.append(stack.pop())
                            on.discard(group[-1])
                        out.append(group)
        return out

    def summaries(self, clean: set[int]) -> dict[int, list[int]]:
        """argument -> calls whose value holds it: those of functions in which the parameter's value reaches a return.

        A function's summary is worked out when those of the functions that it calls are there; among functions that
        call each other, again until none changes.
        """
        edges: dict[int, list[int]] = defaultdict(list)
        takes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # parameter -> (argument, call)
        for argument, call, _, parameter in self.arguments:
            takes[parameter].append((argument, call))
        done: set[int] = set()
        for group in self.components():
            changed = True
            while changed:
                changed = False
                for f in group:
                    ends = set(self.returns[f])
                    for p in self.parameters[f]:
                        if p in done or p in clean:
                            continue
                        seen, walk = {p}, [p]
                        while walk:
                            n = walk.pop()
                            for m in (*self.next.get(n, ()), *edges.get(n, ())):
                                if m not in seen and m not in clean:
                                    seen.add(m)
                                    walk.append(m)
                        if not ends.isdisjoint(seen):
                            done.add(p)
                            changed = changed or len(group) > 1 or f in self.called_in[f]
                            for argument, call in takes[p]:
                                edges[argument].append(call)
        return edges


def tainted(program: Program, sources: list[tuple[int, str, tuple | None]], sinks: list[tuple[int, tuple | None]], clean: set[int], depth: int | None) -> list[tuple[int, set[int]]]:
    """(sink, numbers of the sources) of every sink that satisfied labels reach. sources: (node, label, requires).

    What a node holds is a set of sources, as bits of a number; sets that meet are joined. The labels of a set are those of
    its sources; a source that requires labels is one where they arrive. Values go from a function to its callers first and
    into callees after; a call in between is crossed by its summary, so a value never comes back to another caller than
    it came from. Steps are counted, so that a value travels `depth` edges at most; at a sanitizer it ends.
    """
    summary = program.summaries(clean)
    up: dict[int, list[int]] = defaultdict(list)
    for f, ends in program.returns.items():
        for r in ends:
            up[r] += program.calls[f]
    down: dict[int, list[int]] = defaultdict(list)
    for argument, _, _, parameter in program.arguments:
        down[argument].append(parameter)
    of_label: dict[str, int] = defaultdict(int)
    waiting: dict[int, list[int]] = defaultdict(list)
    arrived: dict[tuple[int, bool], int] = defaultdict(int)
    front: dict[tuple[int, bool], int] = defaultdict(int)
    for i, (node, label, requires) in enumerate(sources):
        of_label[label] |= 1 << i
        if requires is None:
            front[node, False] |= 1 << i
        else:
            waiting[node].append(i)
    labels = lambda bits: {name for name, own in of_label.items() if bits & own}
    sent: dict[tuple[int, bool], int] = defaultdict(int)
    step = 0
    while front and (depth is None or step < depth):
        coming: dict[tuple[int, bool], int] = defaultdict(int)
        for (n, below), bits in front.items():
            bits &= ~sent[n, below]
            if not bits:
                continue
            sent[n, below] |= bits
            for m in (*program.next.get(n, ()), *summary.get(n, ())):
                coming[m, below] |= bits
            if not below:
                for m in up.get(n, ()):
                    coming[m, False] |= bits
            for m in down.get(n, ()):
                coming[m, True] |= bits
        front = defaultdict(int)
        for (n, below), bits in coming.items():
            new = 0 if n in clean else bits & ~arrived[n, below]
            if not new:
                continue
            arrived[n, below] |= new
            front[n, below] |= new
            for i in waiting.get(n, ()):
                if satisfied(sources[i][2], labels(arrived.get((n, False), 0) | arrived.get((n, True), 0))):
                    front[n, False] |= 1 << i
        step += 1
    out = []
    for node, requires in sinks:
        bits = arrived.get((node, False), 0) | arrived.get((node, True), 0)
        if bits and satisfied(requires, labels(bits)):
            out.append((node, {i for i in range(len(sources)) if bits >> i & 1}))
    return out
