"""Frames that compare across engines."""

DATA = "/root/testdata/sf0.001"


def rows(frame):
    """A pandas frame as sorted rows that compare across engines; columns by name."""
    import math

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if isinstance(v, (bool, str, bytes, bytearray)):
            return bytes(v) if isinstance(v, bytearray) else v
        return round(float(v), 8) if isinstance(v, float) or (hasattr(v, "dtype") and v.dtype.kind == "f") else int(v) if math.isfinite(v) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)
