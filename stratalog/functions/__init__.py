"""Column functions: key codecs whose byte order is the order of what they encode."""

from .codecs import bigint_key, composite_key, decode_bigint, decode_text, double_key, padded_key, text_key

__all__ = ["bigint_key", "composite_key", "decode_bigint", "decode_text", "double_key", "padded_key", "text_key"]
