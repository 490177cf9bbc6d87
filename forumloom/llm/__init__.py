"""Training-data operators: each works on whole tables, cuts lineage only in the cluster's shared folder."""
