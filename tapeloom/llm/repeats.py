"""Which hashes occur more than once, and which rows hold them.

Each task first looks at what its own block holds. A hash met twice there is
answered on the spot and sent once, marked known; a hash that the task has sent
as known before is not sent again. So a hash that a third of all rows hold costs
a row or two for each task in the shuffle, and answers are spread over the rows'
own keys.
"""

from __future__ import annotations

import numpy as np

from tapeloom.llm.text import U

#: Known hashes a task remembers; when there are more it forgets all and goes on (only traffic grows).
MEMORY = 1 << 18


class Known:
    """What one task has sent as known."""

    def __init__(self):
        self.hashes = np.empty(0, U)

    def split(self, hashes: np.ndarray, doubled: np.ndarray | None = None
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(answered here, to send, to send as known) for the places of a block.

        doubled marks places that are known to occur elsewhere as well.
        """
        _, first, group, count = np.unique(
            hashes, return_index=True, return_inverse=True, return_counts=True)
        known = count > 1
        if doubled is not None and doubled.any():
            known = known.copy()
            known[group[doubled]] = True
        old = np.isin(hashes[first], self.hashes)
        repeated = (known | old)[group]
        send = np.zeros(len(hashes), bool)
        send[first[~old]] = True
        marked = send & known[group]
        if len(self.hashes) > MEMORY:
            self.hashes = np.empty(0, U)
        self.hashes = np.union1d(self.hashes, hashes[marked])
        return repeated, send, marked
