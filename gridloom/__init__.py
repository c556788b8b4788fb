"""gridloom: lattice quantisation, vector recall and byte analytics as Spark DataFrame operators."""
