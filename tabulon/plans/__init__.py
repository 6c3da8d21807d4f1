"""Plans: what a sheet is, where its columns go, what stands in the way, and the verbs that act on it."""
