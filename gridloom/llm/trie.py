"""A trie over words whose nodes each hold the state of a left-to-right dynamic program, made once."""

from __future__ import annotations


END = 0x110000
SPAN = 2 * END


class Trie:
    """Subclasses give begin() -> the root's state, and step(word, d, states, last) -> the state of word[:d].

    states[j] is the state of word[:j] for j < d; last says that word ends at d. A node is a prefix; a
    word's end is a node of its own, since a word's last character may count differently there.
    Words that share a prefix share the states of its nodes. Beyond max_nodes the trie starts anew, so
    its memory is bounded; a word longer than max_path is scored along a path of its own, not kept.
    """

    def __init__(self, max_nodes: int = 400_000, max_path: int = 256):
        self.max_nodes, self.max_path = max_nodes, max_path
        self.clear()

    def clear(self):
        #: Child of a node, by node and character in one number; a word's end as a character beyond Unicode's.
        self.edges: dict[int, int] = {}
        self.state = [self.begin()]

    def walk(self, words):
        """(word, states of its prefixes, the last that of the whole word) for each word.

        Sorted, the words are the trie in depth-first order: each one goes on from the deepest node that
        it shares with those before it.
        """
        for word in sorted(words):
            n = len(word)
            if n > self.max_path:
                states = [self.begin()]
                for d in range(1, n + 1):
                    states.append(self.step(word, d, states, d == n))
                yield word, states
                continue
            if len(self.state) > self.max_nodes:
                self.clear()
            node, states, edges, state, d = 0, [self.state[0]], self.edges, self.state, 0
            for c in word[:-1]:
                d += 1
                key = node * SPAN + ord(c)
                to = edges.get(key)
                if to is None:
                    to = edges[key] = len(state)
                    state.append(self.step(word, d, states, False))
                node = to
                states.append(state[node])
            key = node * SPAN + ord(word[-1]) + END
            to = edges.get(key)
            if to is None:
                to = edges[key] = len(state)
                state.append(self.step(word, n, states, True))
            states.append(state[to])
            yield word, states
