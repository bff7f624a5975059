"""Operations that run in the background, with progress and cancellation."""
