"""Training-data operators on document tables (packing, sharding, deduplication, scoring).

Nothing outside this subpackage imports it. Every operator reads only the id and text
columns it is given and renames them on the way in, so further columns of the input, also
ones named like internal columns, have no effect.
"""
