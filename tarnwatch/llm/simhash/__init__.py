"""SimHash near-dedup.

* :func:`near_duplicates`: 64-bit fingerprints, all links of at most ``radius`` differing bits by
  vantage-point search (:mod:`.search`).
* :func:`groups` and :func:`keep_first`: near copies at a given similarity of word shingles, from
  long fingerprints whose bound covers that similarity, confirmed on the shingle sets (:mod:`.similar`).
"""

from .search import components, edges, fingerprints, near_duplicates, pivots, vantage_forest
from .similar import groups, keep_first

__all__ = ["components", "edges", "fingerprints", "groups", "keep_first", "near_duplicates", "pivots", "vantage_forest"]
