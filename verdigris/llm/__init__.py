"""Operations of a training-data pipeline over large text tables. Nothing outside imports this package."""
