"""Engine facade, registry, codecs, review and contract checks."""
