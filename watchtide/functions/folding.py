"""Order-dependent folds that run in Python workers; imports nothing that needs a driver."""

from __future__ import annotations

import json

import pandas as pd


def fold_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Play the openings and resolves of one connected part in time order."""
    pdf = pdf.assign(order=(pdf["what"] == "resolve").astype(int)).sort_values(["at", "order", "service"])
    opened: dict[str, object] = {}
    out = []
    for row in pdf.itertuples(index=False):
        if row.what == "resolve":
            opened.pop(row.service, None)
            continue
        candidates = [(opened[n], n) for n in row.near if n in opened]
        host = min(candidates)[1] if candidates else row.service
        opened.setdefault(host, row.at)
        out.append((row.tenant_id, row.part, row.service, row.stretch, host, opened[host]))
    return pd.DataFrame(out, columns=["tenant_id", "part", "service", "stretch", "host", "opened"])


def _joined(frames) -> pd.DataFrame:
    frames = [f for f in frames if len(f)]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame()


def _micros(value) -> int:
    return pd.Timestamp(value).value // 1000


def _stamp(us):
    return pd.NaT if us is None else pd.Timestamp(us * 1000)


class RuleCycles:
    """Firing of one rule over its evaluation cycles, corrected when counts come late.

    Holds the counts of a stretch of cycles, the state before it, and the changes told so far. A rule is evaluated at the
    end of each cycle over its trailing window; between the cycles where a count enters or leaves the window nothing can
    change, so only those are looked at, however long a silence lasts. Times are microseconds.
    """

    def __init__(self, kind: str, threshold: float | None, window: int, cycle: int, known: dict | None = None):
        self.kind, self.threshold, self.window, self.cycle = kind, threshold, window, cycle
        known = known or {}
        self.first, self.last = known.get("first"), known.get("last")
        self.base: bool = known.get("base", False)
        self.counts: dict[int, int] = {int(k): v for k, v in known.get("counts", {}).items()}
        self.changes: dict[int, bool] = {int(k): v for k, v in known.get("changes", {}).items()}
        self.base_fired, self.edge = known.get("base_fired"), known.get("edge")

    def known(self) -> dict:
        return {"first": self.first, "last": self.last, "base": self.base, "base_fired": self.base_fired, "edge": self.edge, "counts": self.counts, "changes": self.changes}

    def _fires(self, total: int) -> bool:
        if self.kind == "absence":
            return total == 0
        return self.kind == "threshold" and self.threshold is not None and total > self.threshold

    def _leaves(self, at: int) -> int:
        """The first cycle whose window no longer holds a count of ``at``."""
        return -(-(at + self.window) // self.cycle) * self.cycle

    def add(self, counts: dict[int, int], until: int | None = None) -> list[tuple[int, bool, int | None, bool]]:
        """Take in counts by cycle and evaluate to the newest of them or ``until``; (cycle, firing, fired at, withdrawn)
        of every change that is new, differs from what was told, or no longer holds."""
        if self.edge is not None:
            counts = {at: n for at, n in counts.items() if at >= self.edge}
        for at, n in counts.items():
            if n:
                self.counts[at] = self.counts.get(at, 0) + n
        seen = [*counts, *([until] if until is not None and self.first is not None else [])]
        if not seen:
            return []
        self.first = min(seen) if self.first is None else min(self.first, *seen)
        self.last = max(seen) if self.last is None else max(self.last, *seen)
        moments = {self.first, *self.counts, *map(self._leaves, self.counts)}
        told, now, fired, total, entered = self.changes, self.base, self.base_fired, 0, sorted(self.counts)
        self.changes, out, low, high = {}, [], 0, 0
        before = self._fired(told)
        for at in sorted(m for m in moments if self.first <= m <= self.last):
            while high < len(entered) and entered[high] <= at:
                total += self.counts[entered[high]]
                high += 1
            while low < high and entered[low] <= at - self.window:
                total -= self.counts[entered[low]]
                low += 1
            if (fires := self._fires(total)) != now:
                now = fires
                fired = at if fires else fired
                self.changes[at] = fires
                if (fires, fired) != before.get(at):
                    out.append((at, fires, fired, False))
        out += [(at, fires, fired_at, True) for at, (fires, fired_at) in before.items() if at not in self.changes]
        return sorted(out)

    def _fired(self, changes: dict[int, bool]) -> dict[int, tuple[bool, int | None]]:
        fired, out = self.base_fired, {}
        for at in sorted(changes):
            fired = at if changes[at] else fired
            out[at] = changes[at], fired
        return out

    def forget(self, keep: int) -> None:
        """Settle what is older than ``keep`` before the last cycle; later counts of that time change nothing."""
        if self.last is None or (edge := (self.last - keep) // self.cycle * self.cycle) <= self.first:
            return
        for at, (fires, fired) in self._fired(self.changes).items():
            if at < edge:
                self.base, self.base_fired = fires, fired
        self.changes = {at: fires for at, fires in self.changes.items() if at >= edge}
        self.counts = {at: n for at, n in self.counts.items() if self._leaves(at) > edge}
        self.first = self.edge = edge


_INCIDENT = [
    "tenant_id", "service", "rule_name", "confidence", "signal_count", "first_seen", "last_seen",
    "deploy_id", "correlated_rules", "paged_at", "status", "resolved_at",
]


def fold_incidents(key, frames, state, page_at):
    """Opening, growing and closing the incidents of one service."""
    tenant, service = key
    current = json.loads(state.get[0]) if state.exists else None
    touched = []

    def show(incident, status, resolved):
        return (
            tenant, service, incident["name"], incident["confidence"], incident["count"], _stamp(incident["first"]),
            _stamp(incident["last"]), incident["deploy"], incident["rules"], _stamp(incident["paged"]), status, _stamp(resolved),
        )

    pdf = _joined(frames)
    grown = False
    if len(pdf):
        pdf = pdf.assign(order=(pdf["what"] == "resolve").astype(int)).sort_values(["timestamp", "order", "rule_id", "deploy_id"])
    for row in pdf.itertuples(index=False):
        at = _micros(row.timestamp)
        if row.what == "resolve":
            if current is not None:
                touched.append(show(current, "resolved", at))
            current, grown = None, False
            continue
        if current is None:
            current = {"name": row.rule_name, "confidence": 0.0, "count": 0, "first": at, "deploy": "", "rules": [], "paged": None}
        current["confidence"] = max(current["confidence"], float(row.confidence))
        current["count"] += 1
        current["last"] = at
        current["deploy"] = current["deploy"] or row.deploy_id
        if row.rule_id not in current["rules"]:
            current["rules"].append(row.rule_id)
        if current["paged"] is None and row.confidence >= page_at:
            current["paged"] = at
        grown = True
    if current is not None and grown:
        touched.append(show(current, "open", None))
    if current is None:
        if state.exists:
            state.remove()
    else:
        state.update((json.dumps(current),))
    if touched:
        yield pd.DataFrame(touched, columns=_INCIDENT)
