from .scalar import (  # noqa: F401
    safe_ratio, spatial_block, logit, beta_basis, sigmoid,
    null_safe, bucket_index, md5_int, f1_from_counts, clip, nan_to_null, sha256_of,
)
