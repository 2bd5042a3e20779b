"""cloakwork: reversible document de-identification on Spark DataFrames."""
