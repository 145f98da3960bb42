"""Dense numeric functions: solvers, distributions, weights of ordered averages."""
