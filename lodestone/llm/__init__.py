"""Operations for large-scale training-data preparation.

Nothing outside this folder imports it; it may be removed as a whole.
"""
