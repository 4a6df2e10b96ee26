"""Suffix automata: every substring of a text is a path from the root."""

from __future__ import annotations


class Automaton:
    """Suffix automaton of a text, built online in linear time.

    next[s] maps a character to a state; link[s] is the suffix link, length[s] the length of
    the longest substring of the state.
    """

    __slots__ = ("length", "link", "next")

    def __init__(self, text: str = ""):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str, most: int = 1 << 60) -> int:
        """Phrases of the cross-parsing of text: from each place the longest substring known
        here (one character, if it is unknown). Counting stops above most."""
        nxt, root = self.next, self.next[0]
        n = i = 0
        end = len(text)
        while i < end:
            s = root.get(text[i])
            i += 1
            if s is not None:
                while i < end:
                    s = nxt[s].get(text[i])
                    if s is None:
                        break
                    i += 1
            n += 1
            if n > most:
                break
        return n

    def coverage(self, text: str, least: int) -> int:
        """Characters of text that lie in substrings of at least so many characters that occur
        here (matching statistics along suffix links)."""
        nxt, link, length = self.next, self.link, self.length
        s = size = covered = upto = 0
        for i, ch in enumerate(text):
            while s and ch not in nxt[s]:
                s = link[s]
                size = length[s]
            t = nxt[s].get(ch)
            if t is None:
                size = 0
            else:
                s = t
                size += 1
            if size >= least:
                start = max(upto, i + 1 - size)
                covered += i + 1 - start
                upto = i + 1
        return covered
