"""Fixed values that results depend on."""

#: Tolerances and the finite number that stands for infinity.
EPSILON, SMALL_EPSILON, BIG_EPSILON, INFINITY = 1e-6, 1e-9, 1e-3, 1e6
#: Divisors and values this small count as zero in grid arithmetic.
GRID_ZERO = 1e-20
#: What unknown values are written as in files; in DataFrames they are NULL.
UNKNOWN_PROPERTY, UNKNOWN_GRID2, KEEP_GRID2, INPUT_GRID2 = -1.0, -321.0, -987.0, -654.0
#: Bits of a surfel's flags.
FLAG_TANGENT, FLAG_AERIAL, FLAG_ACTIVE, FLAG_SILHOUETTE, FLAG_SHADOW, FLAG_BORDER, FLAG_NORMAL, FLAG_MARKED = 0x01, 0x02, 0x04, 0x10, 0x20, 0x30, 0x40, 0x80
#: Who made a label assignment.
HUMAN, MACHINE, GROUND_TRUTH, OTHER = 0, 1, 2, 3
