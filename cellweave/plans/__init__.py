"""Plan helpers: materialised intermediates, local columns, global positions, size checks, splits."""

from cellweave.plans.local import local_column
from cellweave.plans.materialize import materialize, new_path, release, shared_dir
from cellweave.plans.position import first_positions, with_position
from cellweave.plans.sizes import estimated_bytes, small_broadcast
from cellweave.plans.spread import input_splits, spread

__all__ = ["estimated_bytes", "first_positions", "input_splits", "local_column", "materialize", "new_path", "release", "shared_dir", "small_broadcast", "spread", "with_position"]
