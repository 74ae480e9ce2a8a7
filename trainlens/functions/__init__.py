"""Column-expression helpers (all JVM-side, codegen friendly)."""

from trainlens.functions.text import (  # noqa: F401
    first_nonblank, is_blank, nonblank, strip, word_tokens,
)
from trainlens.functions.vector import (  # noqa: F401
    dot, l2_norm, l2_normalize, sigmoid,
)
from trainlens.functions.hashing import (  # noqa: F401
    hash_bucket, seeded_order_key,
)
