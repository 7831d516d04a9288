from twinstring.functions.strings import (
    cutoff_distance,
    deletion_variants,
    is_ascii,
    probe_hashes,
    segment_hashes,
    variant_count,
    variant_hashes,
)

__all__ = [
    "cutoff_distance",
    "deletion_variants",
    "is_ascii",
    "probe_hashes",
    "segment_hashes",
    "variant_count",
    "variant_hashes",
]
