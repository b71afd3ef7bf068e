"""The cheapest edits that give a sequence of turns a legal order of roles, by iterative-deepening A*.

Legal are role initials `(s?(ua)+)?`. Rows are kept (K), deleted (D) or given another role (R), and turns are inserted
(I). The state says what came last, so each edit has one outcome. A search goes depth first in ASCII order of
the edits under a bound of cost, which rises until a path is found: that path is the cheapest and, of equals, the
ASCII-least. A table keeps for each place and state the cost within which no path was found.

Long conversations are cut into segments. `segment_paths` gives the best edits between any two states; as two ways of equal cost
between the same states never begin one another, best segments make best conversations.
"""

from functools import lru_cache

KEEP, DELETE, INSERT, REROLE, TRUNCATED = 0, 4, 3, 3, 3
#: Nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
#: The state after a turn with the one role that may be inserted or given there.
_GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row as (role initial, fault): a fault is none, to be deleted, or truncated.
SOUND, LOST, CUT = 0, 1, 2


def _least(rows):
    """The cost that the rows from each place on have at least."""
    costs = [0]
    for _, fault in reversed(rows):
        costs.append(costs[-1] + (DELETE if fault == LOST else min(DELETE, TRUNCATED) if fault == CUT else 0))
    return costs[::-1]


def cheapest(rows, start, ends, insert_at_end):
    """(cost, edits, end) of the cheapest edits from `start` to one of the states `ends`; of equals the ASCII-least.

    None if no edits lead there. With `insert_at_end`, turns may follow the last row.
    """
    least, n = _least(rows), len(rows)
    failed = {}
    # Nothing leads back to the first two states; user and assistant turns follow each other without end.
    last = max(ends) if max(ends) < USER else ASSISTANT

    def search(i, state, left):
        """The edits from row i on, within the cost `left`, as (edits, cost, end); otherwise the cost that would let it go on."""
        if i == n and state in ends:
            return "", 0, state
        if state > last:
            return _NEVER
        short = failed.get((i, state), least[i])
        if short > left:
            return short
        lowest = _NEVER
        for edit, cost, to, consumes in _edits(rows, i, state, insert_at_end):
            below = search(i + consumes, to, left - cost) if cost <= left else cost + least[i + consumes]
            if isinstance(below, tuple):
                return edit + below[0], cost + below[1], below[2]
            if cost <= left:
                below += cost
            lowest = min(lowest, below)
        failed[i, state] = lowest
        return lowest

    bound = least[0]
    while bound < _NEVER:
        found = search(0, start, bound)
        if isinstance(found, tuple):
            return found[1], found[0], found[2]
        bound = found
    return None


_NEVER = 1 << 60


def _edits(rows, i, state, insert_at_end):
    """(edit, cost, next state, rows consumed) in ASCII order of the edits."""
    if i == len(rows):
        if insert_at_end:
            yield "I", INSERT, _GIVEN[state], 0
        return
    initial, fault = rows[i]
    yield "D", DELETE, state, 1
    yield "I", INSERT, _GIVEN[state], 0
    if fault == LOST:
        return
    extra = TRUNCATED if fault == CUT else 0
    kept = _KEPT[state].get(initial)
    if kept is not None:
        yield "K", KEEP + extra, kept, 1
    yield "R", REROLE + extra, _GIVEN[state], 1


@lru_cache(maxsize=1 << 16)
def whole_path(rows):
    """(cost, edits) of a conversation given as a tuple of rows."""
    cost, edits, _ = cheapest(rows, START, (START, ASSISTANT), True)
    return cost, edits


@lru_cache(maxsize=1 << 14)
def _paths_from(rows, start):
    found = [(end, cheapest(rows, start, (end,), False)) for end in range(4)]
    return {end: path[:2] for end, path in found if path is not None}


def segment_paths(rows, starts=range(4)):
    """{from: {to: (cost, edits)}}: the best edits of a segment between each two states, without turns after its last row."""
    return {start: _paths_from(rows, start) for start in starts}


def followed(best, paths):
    """The best (cost, edits) by end state after one more segment; `best` is what was best by state before it."""
    after = {}
    for state, (cost, edits) in best.items():
        for end, (more_cost, more_edits) in paths[state].items():
            way = (cost + more_cost, edits + more_edits)
            if end not in after or way < after[end]:
                after[end] = way
    return after


def finished(best):
    """The best (cost, edits) of a conversation whose segments are all joined; turns may follow its last row."""
    ways = []
    for state, (cost, edits) in best.items():
        while state not in (START, ASSISTANT):
            cost, edits, state = cost + INSERT, edits + "I", _GIVEN[state]
        ways.append((cost, edits))
    return min(ways)


def outcome(state, edit, initial):
    """The state after an edit, and the turn's role: None for its own, empty for no turn. `initial` is the row's, if it takes one."""
    if edit == "D":
        return state, ""
    if edit == "K":
        return _KEPT[state][initial], None
    state = _GIVEN[state]
    return state, _NAMES[state]
