"""User-declared state machines as table functions: a regular expression per state, transitions
with conditions, and an extraction rule."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.clean import unescape_text


@dataclass
class State:
    name: str
    regex: str
    capture_group: int | None = None
    is_final: bool = False
    transitions: list[tuple[str, str | None]] = field(default_factory=list)


class MachineBuilder:
    """MachineBuilder("t").initial("a").state("a", "x").transition("a", "b").accepting("b")...build()"""

    def __init__(self, name: str):
        self._name, self._initial, self._accepting, self._states, self._rule = name, None, [], {}, {"type": "none"}

    def initial(self, name: str):
        self._initial = name
        return self

    def accepting(self, name: str):
        self._accepting.append(name)
        return self

    def state(self, name: str, regex: str, group: int | None = None, final: bool = False):
        self._states[name] = State(name, regex, group, final)
        return self

    def transition(self, source: str, target: str, condition: str | None = None):
        self._states[source].transitions.append((target, condition))
        return self

    def rule(self, rule: dict):
        self._rule = rule
        return self

    def build(self) -> "Machine":
        if not self._name or not self._initial:
            raise ValueError("a machine needs a name and an initial state")
        return Machine(self._name, self._initial, self._accepting, list(self._states.values()), self._rule)


class Machine:
    """Finds matches from each place on; it goes on behind a match, else one character further."""

    def __init__(self, name: str, initial: str, accepting: list[str], states: list[State], rule: dict | None = None):
        self.name, self.initial, self.accepting, self.rule = name, initial, set(accepting), rule or {"type": "none"}
        self.states = {s.name: s for s in states}
        if initial not in self.states:
            raise ValueError(f"no initial state {initial!r}")
        if not accepting and not any(s.is_final for s in states):
            raise ValueError("no accepting state")
        for a in accepting:
            if a not in self.states:
                raise ValueError(f"no accepting state {a!r}")
        self._re = {s.name: re.compile(s.regex) for s in states}
        self._cond = {(s.name, t): re.compile(c) if c else None for s in states for t, c in s.transitions}

    def match(self, text: str, start: int) -> tuple[str, int, int] | None:
        """(raw text, begin, end) of the last accepting state reached from a place. A state's
        expression may be found anywhere behind the place. A match goes on as long as its states find text; it
        ends where a state is entered again at the same place, as it would go round for ever."""
        state, at, best, begin = self.initial, start, None, None
        here: set[str] = set()  # states entered at this place
        while True:
            m = self._re[state].search(text, at)
            if not m or state in here:
                return best
            here = here | {state} if m.end() == at else set()
            begin = m.start() if begin is None else begin
            s = self.states[state]
            g = s.capture_group
            got = m.group() if not g else (m.group(g) or "") if g <= self._re[state].groups else ""
            if s.is_final or state in self.accepting:
                best = (got, begin, m.end())
            target = next((t for t, _ in s.transitions if not self._cond[state, t] or self._cond[state, t].search(text, m.end())), None)
            if target is None:
                return best
            state, at = target, m.end()

    def extract(self, raw: str) -> str:
        kind = self.rule.get("type", "none")
        t = raw.strip()
        if kind == "remove_quotes":
            return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'" else t
        if kind == "remove_brackets":
            pair = {"round": "()", "square": "[]", "curly": "{}"}.get(self.rule.get("bracket_type"))
            return raw if not pair else t[1:-1] if len(t) > 1 and t[0] == pair[0] and t[-1] == pair[1] else t
        if kind == "regex":
            m = re.search(self.rule["pattern"], raw)
            g = int(self.rule.get("group", 0))
            return (m.group(g) or raw) if m and g <= m.re.groups else raw
        if kind == "unescape":
            return unescape_text(raw)
        return raw

    def find(self, text: str) -> list[tuple[str, str, int, int]]:
        """[(raw, extracted, begin, end)] in characters."""
        out, at = [], 0
        while at < len(text):
            m = self.match(text, at)
            if m is None:
                break
            raw, a, b = m
            out.append((raw, self.extract(raw), a, b))
            at = max(b, at + 1)
        return out


def machine_matches(files: DataFrame, machine: Machine, text: str = "text", exts: list[str] | None = None) -> DataFrame:
    """(path, pattern_name, idx, raw_match, content, begin, end) of every match in files(path, ext, text)."""
    rows = files if not exts or "*" in exts else files.where(F.lower("ext").isin([e.lower() for e in exts]))

    def run(batches):
        for pdf in batches:
            out = [(p, machine.name, i, *m) for p, t in zip(pdf["path"], pdf["t"]) if t is not None for i, m in enumerate(machine.find(t))]
            yield pd.DataFrame(out, columns=["path", "pattern_name", "idx", "raw_match", "content", "begin", "end"])

    return rows.select("path", F.col(text).alias("t")).mapInPandas(run, "path string, pattern_name string, idx int, raw_match string, content string, begin int, end int")
