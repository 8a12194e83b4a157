"""A document-view engine on Spark: declarative views over nested documents, derived read models and governance."""
