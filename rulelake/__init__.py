"""rulelake: declarative rule search over source code and text, as Spark plans."""
