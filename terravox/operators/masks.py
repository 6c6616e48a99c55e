"""Fixed weights of 3 x 3 and 3 x 3 x 3 masks, x fastest."""

SOBEL_X = (-0.25, 0, 0.25, -0.5, 0, 0.5, -0.25, 0, 0.25)
SOBEL_Y = (-0.25, -0.5, -0.25, 0, 0, 0, 0.25, 0.5, 0.25)
LAPLACE2 = (*(-0.125,) * 4, 1.0, *(-0.125,) * 4)
LAPLACE3 = (*(-1 / 26,) * 13, 1.0, *(-1 / 26,) * 13)
