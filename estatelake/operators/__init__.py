"""Row-wise and relational steps over listing frames; each takes and returns DataFrames."""
